"""lattiq: graph analytics and large-scale data preparation as Spark plans."""
