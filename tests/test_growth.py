"""Every registered query's work grows with the tables: its output grows
from sf0.001 to sf0.01, except the reports whose size is fixed by design."""

from conftest import SF_CHECK, SF_SMALL
from tableflow.queries import QUERIES

# one-row or fixed-row reports: counts, checks, a 20-row preview, file stats
FIXED_SIZE = {"row_count", "non_empty", "preview", "expect_row_count", "expect_predicates", "single_file_output"}


def test_outputs_grow_with_scale(spark):
    flat = []
    for name, q in QUERIES.items():
        if name in FIXED_SIZE:
            continue
        small, large = q(spark, SF_SMALL).count(), q(spark, SF_CHECK).count()
        if not large > small:
            flat.append((name, small, large))
    assert not flat, flat


def test_fixed_size_reports_still_scan_growing_tables(spark):
    small = QUERIES["row_count"](spark, SF_SMALL).first()[0]
    large = QUERIES["row_count"](spark, SF_CHECK).first()[0]
    assert large > small
