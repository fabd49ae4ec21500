"""Plan-level helpers: cutting lineage, distributed prefix sums, picking columns safely."""
