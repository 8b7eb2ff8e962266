import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import layout, pages

BOX = "x0 double, y0 double, x1 double, y1 double"


def boxes(rng, n, wide):
    x, y = rng.integers(0, 3000, n), rng.integers(0, 560, n)
    return [(float(a), float(b), float(a + w), float(b + h)) for a, b, w, h in zip(x, y, rng.integers(1, wide, n), rng.integers(1, 60, n))]


def dealt(df):
    return re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture(scope="module")
def page(spark):
    """Two pages of random rows in random order, with boxes as wide as a page and one of no bounds."""
    rng = np.random.default_rng(11)
    spans = [("d", i % 2, i // 7, i, *b) for i, b in enumerate(boxes(rng, 400, 60))]
    others = [("d", int(rng.integers(0, 2)), i, *b) for i, b in enumerate([*boxes(rng, 150, 300), *boxes(rng, 6, 6000), (-1e9, -1e9, 1e9, 1e9), (5.0, 5.0, float("inf"), 9e9)])]
    return (
        spans, spark.createDataFrame(spans, f"document_id string, page long, line long, span long, {BOX}").repartition(3),
        others, spark.createDataFrame(others, f"document_id string, page long, shape_id long, {BOX}").repartition(2),
    )


@pytest.mark.parametrize("sizes", [(256, 1 << 20, 1 << 15), (7, 1 << 20, 0), (64, 50, 0)])
def test_the_first_box_however_many_at_once(monkeypatch, sizes):
    for name, value in zip(("AT_ONCE", "PAIRS", "FEW_PAIRS"), sizes):
        monkeypatch.setattr(pages, name, value)
    rng = np.random.default_rng(3)
    x0, y0, x1, y1 = np.array([*boxes(rng, 200, 400), *boxes(rng, 9, 9000), (-1e9, -1e9, np.inf, np.inf)]).T[:, rng.permutation(210)]
    x, y = rng.integers(0, 4000, 500).astype(float), rng.integers(0, 600, 500).astype(float)
    flags = lambda i, near: (x0[near] <= x[i, None]) & (x[i, None] <= x1[near]) & (y0[near] <= y[i, None]) & (y[i, None] <= y1[near])
    all_ = flags(slice(0, 500), slice(None))
    found = pages.first_of(pages.Ranges(y0, y1), y, y, flags, (x0, x1), (x, x))
    assert found.tolist() == np.where(all_.any(1), all_.argmax(1), -1).tolist()


def test_bounds_of_random_pages(page):
    """The smallest container of each span by a plain search; spans leave for their page alone."""
    spans, span_rows, others, shapes = page
    found = layout.text_bounds(span_rows, shapes, layout.page_areas(span_rows, 640.0, 600.0))
    assert not [x for x in dealt(found) if "line" in x]
    own = {r["span"]: r["container"] for r in found.collect()}
    assert len(own) == len(spans)
    for _, p, _, i, x0, y0, x1, y1 in spans:
        around = [((c - a) * (d - b), k) for _, q, k, a, b, c, d in others if q == p and c - a > 5 and d - b > 5 and a <= x0 - 1 and b <= y0 - 1 and c >= x1 + 1 and d >= y1 + 1]
        assert own[i] == (min(around)[1] if around else None)


def test_links_of_random_pages(page):
    spans, span_rows, others, shapes = page
    links = shapes.select("document_id", "page", F.col("shape_id").alias("link_id"), F.concat(F.lit("to"), "shape_id").alias("target"), *layout.SIDES)
    found = layout.link_char_join(span_rows, links)
    assert not [x for x in dealt(found) if "line" in x or "cell" in x]
    want = {}
    for _, p, _, i, x0, y0, x1, y1 in spans:
        m, x, y = 0.2 * min(x1 - x0, y1 - y0), (x0 + x1) / 2, (y0 + y1) / 2
        over = [k for _, q, k, a, b, c, d in others if q == p and a - m <= x <= c + m and b - m <= y <= d + m]
        if over:
            want[i] = f"to{min(over)}"
    assert {r["span"]: r["target"] for r in found.collect()} == want and len(want) > 50


def test_limits_of_random_pages(page):
    spans, span_rows, others, shapes = page
    bounds = span_rows.select("document_id", "page", "line", "span", *[F.lit(v).alias(f"b_{c}") for c, v in zip(layout.SIDES, (-50.0, 0.0, 9000.0, 700.0))])
    found = layout.free_space_limits(span_rows, shapes, bounds)
    assert not [x for x in dealt(found) if "line" in x or "y0" in x]
    own = {r["span"]: (r["left_limit"], r["right_limit"], r["bottom_limit"]) for r in found.collect()}
    assert len(own) == len(spans)
    for _, p, _, i, x0, y0, x1, y1 in spans:
        here, band = [o[3:] for o in others if o[1] == p], (y1 - y0) / 4
        beside = [o for o in here if o[1] < y1 - band and o[3] > y0 + band]
        right, left = [o[0] for o in beside if o[0] >= x1 - 0.5], [o[2] for o in beside if o[2] <= x0 + 0.5]
        under = [o[1] for o in here if o[1] >= y1 - 0.5 and o[0] < x1 and o[2] > x0]
        assert own[i] == (max([-50.0, *left]), min([9000.0, *right]), min([700.0, *under]))
