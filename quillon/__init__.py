"""quillon: a Spark-first engine for rarity-weighted knowledge graphs and three-valued matching."""
