"""Every registered query against its SQL, and the plans of some of them."""

import compare
import pytest

from tamnan import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toArrow()
    if name in SQL:
        want = duck.execute(SQL[name])
        want = want.to_arrow_table() if hasattr(want, "to_arrow_table") else want.arrow()
        want = want if hasattr(want, "column_names") else want.read_all()
        assert compare.difference(got, want) == ""
    else:
        assert got.num_columns


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_what_it_needs(spark, sf):
    text = plan(QUERIES["prefix_negative_filter"](spark, sf))
    assert "PushedFilters" in text and "evidence" not in text and "fetched_at" not in text


def test_top_k_is_limited_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(QUERIES["cosine_topk"](spark, sf))


def test_no_cartesian_product(spark, sf):
    for name in ("hybrid_search", "fusion_grid", "neighbour_expand", "interval_photos", "containment_join", "coverage_probe"):
        assert "CartesianProduct" not in plan(QUERIES[name](spark, sf)), name


def test_context_holds_every_hit_whole(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    blocks = {r.qid: r.block for r in QUERIES["hits_context_block"](spark, sf).collect()}
    hits = QUERIES["hybrid_search"](spark, sf).collect()
    assert max(h.pos for h in hits) > 6 and {h.qid for h in hits} == set(blocks)
    assert all(f"[{h.pos}] " in blocks[h.qid] and (texts[h.doc_id] or "") in blocks[h.qid] for h in hits)
