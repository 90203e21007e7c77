"""lexigauge: DataFrame operators for grading translation and term-grounding runs at scale."""
