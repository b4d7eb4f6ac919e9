"""Differences, their clean-up, reports and reviews against plain sequential models."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.alignment import differences, merged_changes
from tessera.operators.cleanup import cleaned, report, scored, verified
from tessera.operators.matching import _script

from .test_alignment import _like

BLOCK = "job long, side string, pos long, page long, type string, block_type string, section_title string, text string, headers array<string>, rows int, cols int, cells array<struct<row int, col int, text string>>, y double, height double"
DIFF = "job long, number int, page_a long, page_b long, type string, before string, after string, context string, y_a double, height_a double, y_b double, height_b double, significance string, confidence double, auto_confirmed boolean, summary string"


def block(side, pos, kind, text, title=None, headers=(), rows=None, cols=None, cells=None, page=1, block_type=None):
    return (1, side, pos, page, kind, block_type, title, text, list(headers), rows, cols, cells, 0.4, 0.1)


def test_every_branch_of_the_differences(spark):
    grid = lambda *lines: [(i, j, t) for i, line in enumerate(lines) for j, t in enumerate(line)]
    a = [
        block("a", 0, "text", "pay 10 now and ship 5 boxes", "Terms"), block("a", 1, "text", "same   text"), block("a", 2, "table", "", None, ["x", "y"], 2, 6),
        block("a", 3, "annotation", "note"), block("a", 4, "", "gone", "", block_type="heading"), block("a", 5, "text", "was text"), block("a", 6, "annotation", "left"),
        block("a", 7, "table", None, "T", ["h"], 3, 2, grid(["1,000", "a"], ["left", "row"], ["keep", "2.0"])), block("a", 8, None, None), block("a", 9, "text", "one two three"), block("a", 10, "table", "old"),
    ]
    b = [
        block("b", 0, "text", "pay 12 now and ship 7 boxes"), block("b", 1, "text", "same text"), block("b", 2, "table", "", None, ["x", "z"], 3, 4), block("b", 4, "table", "t"),
        block("b", 5, "annotation", "now a note", "S"), block("b", 6, "text", "right"), block("b", 8, "text", ""), block("b", 9, "text", "one three"),
        block("b", 7, "table", None, None, ["h"], 3, 2, [(0, 0, "1000"), (0, 1, "first"), (0, 1, "b"), (2, 0, "keep"), (2, 1, "2"), (5, 0, "quite"), (5, 1, "new")]),
    ]
    aligned = [(i, i, None) for i in (0, 1, 2, 5, 6, 7, 8, 9)] + [(3, None, None), (4, None, None), (10, None, None), (None, 4, None), (None, None, 7)]
    aligned = spark.createDataFrame([(1, x, y, 0.5, s) for x, y, s in aligned], "job long, a long, b long, score double, scope long")
    got = differences(spark.createDataFrame([*a, *b], BLOCK), aligned).orderBy("number").collect()
    assert [r.number for r in got] == list(range(1, len(got) + 1))
    assert [(r.a, r.b, r.page_a, r.page_b, r.type, r.before, r.after, r.context) for r in got] == [
        (0, 0, 1, 1, "text_modification", "10 5", "12 7", "Section: Terms"),
        (2, 2, 1, 1, "table_structure_change", "x, y", "x, z", "Block type: table"),
        (3, None, 1, None, "annotation_removed_from_b", "note", "", "annotation"),
        (4, None, 1, None, "text_deletion", "gone", "", "heading"),
        (5, 5, 1, 1, "annotation_present_in_b", "was text", "now a note", "Section: S"),
        (6, 6, 1, 1, "annotation_removed_from_b", "left", "right", "Block type: annotation"),
        (7, 7, 1, 1, "table_row_deletion", "Row 1", "", "Section: T"),
        (7, 7, 1, 1, "table_row_addition", "", "Row 5", "Section: T"),
        (7, 7, 1, 1, "table_cell_change", "a", "b", "Row 0, Col 1"),
        (7, 7, 1, 1, "table_cell_change", "left", "", "Row 1, Col 0"),
        (7, 7, 1, 1, "table_cell_change", "row", "", "Row 1, Col 1"),
        (7, 7, 1, 1, "table_cell_change", "", "quite", "Row 5, Col 0"),
        (7, 7, 1, 1, "table_cell_change", "", "new", "Row 5, Col 1"),
        (9, 9, 1, 1, "text_deletion", "two", "", "Block type: text"),
        (10, None, 1, None, "table_row_deletion", "old", "", "table"),
        (None, 4, None, 1, "table_row_addition", "", "t", "table"),
        (None, None, 7, None, "text_deletion", "[Entire page 7 content -- not present in Version B]", "", "text"),
    ]
    assert got[-1].y_a == 0.0 and got[0].y_a == 0.4


def test_a_pair_of_texts_is_one_difference(spark):
    """Against the fold of neighbouring changes, whatever their types."""
    r, words = random.Random(3), "a b c d e".split()
    texts = [(" ".join(r.choice(words) for _ in range(r.randint(0, 9))), " ".join(r.choice(words) for _ in range(r.randint(0, 9)))) for _ in range(60)]
    rows = [x for i, (s, t) in enumerate(texts) for x in (block("a", i, "text", s), block("b", i, "text", t))]
    aligned = spark.createDataFrame([(1, i, i, 0.5, None) for i in range(60)], "job long, a long, b long, score double, scope long")
    got = {d.a: (d.type, d.before, d.after) for d in differences(spark.createDataFrame(rows, BLOCK), aligned).collect()}
    want = {}
    for i, (s, t) in enumerate(texts):
        folded = None
        for kind, before, after in _script(s.split(), t.split()):
            new = ("text_" + kind, before, after)
            folded = new if folded is None else ("text_modification", " ".join(v for v in (folded[1], before) if v), " ".join(v for v in (folded[2], after) if v))
        if folded:
            want[i] = folded
    assert got == want and {v[0] for v in want.values()} == {"text_modification", "text_addition", "text_deletion"}


def garbled(t):
    plain = sum(c.isalnum() or c.isspace() for c in t)
    return len(t) >= 2 and bool(re.search(r"[^\x00-\x7FÀ-ɏḀ-ỿ]{3,}", t) or (len(t) > 5 and plain / len(t) < 0.4) or re.search(r"[^\w\s.,;:!?()'\"-]{3,}", t))


def marginal(d):
    for y, h in ((d["y_a"], d["height_a"]), (d["y_b"], d["height_b"])):
        if (y is not None or h is not None) and ((0.5 if y is None else y) < 0.08 or (0.5 if y is None else y) + (h or 0) > 0.95):
            return True
    return any(w in (d["context"] or "").lower() or w in (d["summary"] or "").lower() for w in ("header", "footer", "page number"))


def model(job):
    """The five passes one after the other over a job's differences; what fired is counted."""
    fired = Counter()
    value = lambda d: ((d["before"] or "").strip(), (d["after"] or "").strip())
    one = [d for d in job if not any(map(garbled, value(d)))]
    fired["garbled"] += len(job) - len(one)
    groups = defaultdict(list)
    for d in one:
        if marginal(d):
            groups[(*value(d), d["type"])].append(d)
    two = []
    for d in one:
        group = groups[(*value(d), d["type"])] if marginal(d) else [d]
        if group[0] is d:
            many = {"summary": f"{d['summary']} (repeated on {len(group)} pages)", "significance": "cosmetic", "confidence": 0.98, "auto_confirmed": True}
            two.append(d | many if len(group) > 1 else d)
            fired["repeated"] += len(group) > 1
    number = re.compile(r"^\s*(?:page\s+)?\d+\s*(?:of\s+\d+)?\s*$", re.IGNORECASE)
    three = [d for d in two if not any(number.match(v) for v in value(d))]
    fired["page number"] += len(two) - len(three)
    seen, four = set(), []
    for d in three:
        key = (*value(d), d["page_a"], d["page_b"], d["type"])
        if (max(map(len, value(d))) > 1 and d["type"] != "table_cell_change") and key in seen:
            fired["same"] += 1
            continue
        seen.add(key)
        four.append(d)
    used, merged = set(), []
    for i, d in enumerate(four):
        page, text = d["page_a"] or d["page_b"], value(d)[0]
        if d["type"] != "text_deletion" or not text or not page:
            continue
        best = max(((_like(text[:200], value(e)[1][:200]), -j) for j, e in enumerate(four) if e["type"] == "text_addition" and j not in used and (e["page_b"] or e["page_a"]) == page and value(e)[1]), default=(0, 0))
        if best[0] >= 0.15:
            e = four[-best[1]]
            used |= {i, -best[1]}
            merged.append(d | {"type": "text_modification", "before": text, "after": value(e)[1], "page_b": e["page_b"], "y_b": e["y_b"], "height_b": e["height_b"], "summary": f'Text modified: "{text[:50]}" → "{value(e)[1][:50]}"'})
    fired["merged"] += len(merged)
    out = [d for i, d in enumerate(four) if i not in used] + merged
    return [d | {"number": n} for n, d in enumerate(out, 1)], fired


def test_clean_up_is_the_sequential_one(spark):
    r = random.Random(11)
    values = ["", " ", None, "Total 5", "total 5\t", "\nDraft", "Page 5 of 12", "7", "x", "y", "§§§ a", "नमस्ते", "the fee is 10", " the fee is 12", "the fee is 10 days", "@#$%^&*()", "Company AG", "Company AG", "Company plc"]
    kinds = ["text_deletion", "text_addition", "text_modification", "table_cell_change"]
    rows = []
    for job in range(25):
        for number in range(1, r.randint(2, 30)):
            kind, margin = r.choice(kinds), r.choice([(0.02, 0.03), (0.4, 0.1), (0.9, 0.08), (None, 0.2), (None, None), (0.93, None)])
            before, after = ("", r.choice(values)) if kind == "text_addition" else (r.choice(values), "") if kind == "text_deletion" else (r.choice(values), r.choice(values))
            page = [r.choice([None, 0, 1, 1, 2]), r.choice([None, 0, 1, 1, 2])]
            if job > 12:  # bodies of few values on few pages: equal changes meet
                kind, before, after, page, margin = r.choice(kinds[2:]), r.choice(["Company AG", "x"]), r.choice(["Company plc", "y"]), [1, r.choice([1, 2])], (0.4, 0.1)
            rows.append((job, number, *page, kind, before, after, r.choice(["text", None, "Section: Footer notes" if job < 13 else "text", "table"]), *margin, *r.choice([margin, (0.4, 0.1)]), "material", 0.9, False, r.choice(["s", "the page number" if job < 13 else "s"])))
    names = [c.split()[0] for c in DIFF.split(", ")]
    want, fired = [], Counter()
    for job in range(25):
        out, n = model([dict(zip(names, x, strict=True)) for x in rows if x[0] == job])
        want += [tuple(d[c] for c in names) for d in out]
        fired += n
    r.shuffle(rows)
    got = [tuple(x) for x in cleaned(spark.createDataFrame(rows, DIFF)).select(names).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert min(fired[k] for k in ("garbled", "repeated", "page number", "same", "merged")) >= 3, fired


def test_merged_changes_take_place_and_page_of_the_addition(spark):
    rows = [
        (1, 0, 1, None, "text_deletion", " the fee is 10  ", "", None, None), (1, 1, None, 1, "text_addition", "", "the fee is 12", 0.3, 0.1), (1, 2, None, 1, "text_addition", "", "the fee is 19 zz", 0.5, 0.1),
        (1, 3, None, 2, "text_addition", "", "the fee is 10", 0.1, 0.1), (1, 4, None, None, "text_deletion", "lost", "", None, None), (1, 5, 1, 1, "text_modification", "a", "b", 0.2, 0.1),
    ]
    out = {(r.number, r.page_b, r.type, r.before, r.after, r.y_b, r.merged) for r in merged_changes(spark.createDataFrame(rows, "job long, number int, page_a long, page_b long, type string, before string, after string, y_b double, height_b double")).collect()}
    assert out == {(0, 1, "text_modification", "the fee is 10", "the fee is 12", 0.3, True), (2, 1, "text_addition", "", "the fee is 19 zz", 0.5, False), (3, 2, "text_addition", "", "the fee is 10", 0.1, False), (4, None, "text_deletion", "lost", "", None, False), (5, 1, "text_modification", "a", "b", 0.2, False)}


def test_summaries(spark):
    rows = [("text_addition", None, " new\n"), ("text_deletion", "x" * 61, ""), ("text_modification", "a", "b"), ("table_cell_change", "1", "2"), ("table_row_addition", "", "Row 3"), ("section_moved", "s", ""), ("other", "", ""), ("table_structure_change", "", "")]
    got = [r.summary for r in scored(spark.createDataFrame(rows, "type string, before string, after string")).collect()]
    assert got == ['Text added: "new"', f'Text deleted: "{"x" * 60}…"', 'Text changed from "a" to "b"', 'Table cell changed: "1" → "2"', "Table row added: Row 3", 'Section moved: "s"', "other detected", "Table structure changed (columns or dimensions differ)"]


def test_reports(spark):
    rows = [(1, "material", "confirmed"), (1, "cosmetic", "pending"), (1, "uncertain", "flagged"), (2, "cosmetic", "corrected"), (3, "substantive", "dismissed"), (4, "uncertain", "pending")]
    got = {r.job: r for r in report(spark.createDataFrame(rows, "job long, significance string, status string")).collect()}
    assert (got[1].total, got[1].material, got[1].cosmetic, got[1].verified, got[1].is_partial) == (3, 1, 1, 2, True)
    assert got[1].verdict.startswith("[PARTIAL] 1 material difference(s) found") and got[2].verdict.startswith("1 cosmetic difference(s) only")
    assert got[3].verdict.startswith("1 substantive") and got[4].verdict == "[PARTIAL] No differences detected — documents appear identical."


def test_reviews_count_once_and_log_corrections(spark):
    diffs = spark.createDataFrame([(1, 1, "t", "cosmetic", "pending", "b", "a"), (1, 2, "t", "material", "confirmed", "b", "a"), (1, 3, "t", "material", "pending", "b", None), (1, 4, "t", "x", "pending", "b", "a")], "job long, number int, type string, significance string, status string, before string, after string")
    actions = [(1, 1, 1, "corrected", "material", "new"), (1, 1, 2, "flagged", None, None), (1, 1, 3, "pending", "substantive", None), (1, 2, 1, "dismissed", None, "later"), (1, 3, 5, "pending", None, None)]
    after, log = verified(diffs, spark.createDataFrame(actions, "job long, number int, at int, action string, significance string, after string"))
    assert {(r.number, r.status, r.significance, r.after, r.first_verified) for r in after.collect()} == {(1, "pending", "substantive", "new", True), (2, "dismissed", "material", "later", False), (3, "pending", "material", None, False), (4, "pending", "x", "a", False)}
    assert [(r.number, r["at"], r.original_significance, r.corrected_significance, r.value_after) for r in log.orderBy("at").collect()] == [(1, 1, "cosmetic", "material", "new"), (1, 3, "material", "substantive", "new")]


def plain_cell(text):
    t = text.strip()
    if not t:
        return t
    try:
        num = float(t.replace(",", "").replace(" ", ""))
        return str(int(num)) if num == int(num) else str(num)
    except (ValueError, OverflowError):
        return t


def test_cell_values_are_equal_where_the_model_says_so(spark):
    texts = [" 1,200 ", "1200", "1200.0", "12d", "12f", "12", "0x1p3", "nan", "NaN", "inf", "1,000,000,000,000,000", "1000000000000000", "1e15", "1_000", "1000", "_1", "1__0", "-7.0", "-7", "+7", ".5", "0.50", "5.", "5", "", "  5\t", "n/a", "1.5e3", "1500", "-0", "0", "1e400", "9007199254740993", "9007199254740992", "1 2", "1\t2", "1e20", "100000000000000000000", "3e", "e3", "."]
    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.cell_value(F.col("t")).alias("v")).collect()}
    for x in texts:
        for y in texts:
            assert (got[x] == got[y]) == (plain_cell(x) == plain_cell(y)), (x, y, got[x], got[y])


def test_white_space_of_all_kinds(spark):
    rows = [("text_addition", "", "\n", "cosmetic", 0.97), ("text_deletion", "\t  ", "", "cosmetic", 0.97), ("text_modification", "abc\n", "abc", "cosmetic", 0.99), ("text_modification", "a\x1cb", "a b", "cosmetic", 0.97), ("text_addition", None, " of the\n", "cosmetic", 0.88), ("text_modification", "a. ", "a", "cosmetic", 0.92)]
    got = scored(spark.createDataFrame([r[:3] for r in rows], "type string, before string, after string")).collect()
    assert [(r.significance, r.confidence) for r in got] == [r[3:] for r in rows]


def test_garbage_is_told_by_one_strip(spark):
    """plain texts need no strip, others one; the outcomes are those of the rule in plain Python."""
    import re

    from pyspark.sql import functions as F

    from tessera.functions import text as T

    def model(t):
        s = (t or "").strip(T.WHITE)
        plain = sum(c.isalpha() or c.isnumeric() and c.isdecimal() or c.isspace() for c in s)
        odd = re.search(r"[^\w\s.,;:!?()'\"-]{3,}", s) or re.search(r"[^\x00-\x7FÀ-ɏḀ-ỿ]{3,}", s)
        return len(s) >= 2 and bool(odd or (len(s) > 5 and plain / len(s) < 0.4))

    texts = [None, "", "x", "Status R", "Page 3 of 9", "   ", "#$%", " #$% ", "a#$%", "a.b,c", "......", ".a.b.c", "a......", " ....ab ", "漢字", "漢字漢", "abc\n", "abc\n ", "#$", "tab\there", "été à Noël", "a_b_c_d", "______"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.g, r.p) for r in df.select("i", T.is_garbage(F.col("t")).alias("g"), T.is_page_number(F.col("t")).alias("p")).collect()}
    assert {i: got[i][0] for i in got} == {i: model(t) for i, t in enumerate(texts)}
    assert [t for i, t in enumerate(texts) if got[i][1]] == ["Page 3 of 9"] and got[0][1] is None
    plan = df.where(~T.is_garbage(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(") == 1
