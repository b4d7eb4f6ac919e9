"""The corpus operators' queries over whole tables, and the SQL that gives the same rows where SQL can."""

from .conversation_trie import OP11_SQL, op11_trie
from .decontaminate import OP9_SQL, op9_decontaminate
from .gru_lm import op6_gru
from .hilbert_shards import op2_hilbert
from .langid import op5_langid
from .licenses import OP4_SQL, op4_licenses
from .minhash import OP8_SQL, op8_minhash
from .quality import op3_quality
from .sentencepiece_table import op7_sentencepiece
from .suffix_dedup import op10_suffix_dedup
from .token_files import op13_orc_tokens
from .topk import OP1_SQL, op1_topk
from .whitening import op12_whitening

QUERIES = {
    "op1_topk": op1_topk,
    "op2_hilbert": op2_hilbert,
    "op3_quality": op3_quality,
    "op4_licenses": op4_licenses,
    "op5_langid": op5_langid,
    "op6_gru": op6_gru,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_minhash": op8_minhash,
    "op9_decontaminate": op9_decontaminate,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_trie": op11_trie,
    "op12_whitening": op12_whitening,
    "op13_orc_tokens": op13_orc_tokens,
}

ORACLES = {
    "op1_topk": OP1_SQL,
    "op4_licenses": OP4_SQL,
    "op8_minhash": OP8_SQL,
    "op9_decontaminate": OP9_SQL,
    "op11_trie": OP11_SQL,
}
