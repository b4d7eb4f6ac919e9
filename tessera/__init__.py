"""tessera: document comparison, operational analytics and corpus preparation on Spark."""
