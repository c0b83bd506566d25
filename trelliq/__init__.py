"""trelliq: probabilistic state-space analytics expressed as Spark plans."""
