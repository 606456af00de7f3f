"""Decontamination of documents that are shorter than the item."""

import pytest
from fixtures import saved

from nimbogrid.llm import decontamination

ITEM = " ".join(f"Word{k}" for k in range(30))


def test_document_shorter_than_the_item(spark, tmp_path):
    w = ITEM.split()
    rows = [(1, " ".join(w[:28])), (2, "... " + " ".join(w[3:]) + "!"), (3, " ".join(w[:20])), (4, " ".join(w[:4])), (5, None), (6, ITEM), (7, " ".join(w[:26]) + " other"), (8, " ".join(w[:25])), (9, " ".join(w[:24]))]
    d, b = saved(spark, rows, tmp_path / "d"), spark.createDataFrame([(70, ITEM), (71, "two words"), (72, " ".join(w[::-1]))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"], r["end"]) for r in decontamination.contaminated(d, b).collect()}
    texts = dict(rows)
    want = {(1, 70): (24 / 26, 0, len(texts[1])), (2, 70): (23 / 26, 4, len(texts[2]) - 1), (6, 70): (1.0, 0, len(ITEM)), (7, 70): (22 / 27, 0, len(texts[7])), (8, 70): (21 / 26, 0, len(texts[8]))}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert {r["doc_id"] for r in decontamination.decontaminate(d, b).collect()} == {3, 4, 5, 9}
