"""What counts as boilerplate by default."""

from __future__ import annotations

from payload_metrics.llm import site_lines


def test_lines_on_one_page_in_a_hundred_are_boilerplate(spark):
    long = " ".join(f"word{i}" for i in range(60))
    planted = {"All rights reserved.": 15, long: 15, "on too small a share": 6, "on too few pages": 4}
    rows = [(i, "\n".join([f"own {i}"] + [x for x, n in planted.items() if i < n]), "big") for i in range(1_500)]
    rows += [(2_000 + i, "\n".join([f"own {i}"] + [x for x, n in planted.items() if i < n]), "small") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = {"big": set(), "small": set()}
    for r in site_lines.drop_boilerplate(docs).collect():
        left[r.source] |= set(r.text.split("\n")) & set(planted)
    assert left == {"big": {"on too small a share", "on too few pages"}, "small": {"on too few pages"}}
