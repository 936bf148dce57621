import json

import pytest
from helpers import rows

from clickloom.catalogue import Catalogue
from clickloom.plans import report as G

SPEC = {
    "user_int": [[1, 50, 1], [2, 50, 1], [3, 9, 2]],
    "item_int": [[4, 50, 1]],
    "user_dense": [],
    "seq": {
        "a": {"prefix": "a_seq", "ts_fid": None, "features": [[1, 20], [2, 0]]},
        "b": {"prefix": "b_seq", "ts_fid": 2, "features": [[1, 20], [2, 0]]},
    },
}
SCHEMA = """user_id bigint, label_type int, user_int_feats_1 bigint, user_int_feats_2 bigint, user_int_feats_3 array<bigint>,
    item_int_feats_4 bigint, a_seq_1 array<bigint>, a_seq_2 array<bigint>, b_seq_1 array<bigint>, b_seq_2 array<bigint>"""


@pytest.fixture(scope="module")
def table(spark):
    """Column 2 is twice column 1, column 4 mostly missing with one outlier, domain b mostly empty."""
    data = []
    for i in range(60):
        ts = [1_600_000_000 + i]
        item = 10_000 if i == 0 else (i % 5 + 1 if i < 20 else 0)
        b = [3] if i < 10 else []
        data.append((i, 2 if i < 2 else 1, i + 1, 2 * i + 2, [i % 3, 1], item, [i % 7, 3], ts * 2, b, ts * len(b)))
    return spark.createDataFrame(data, SCHEMA)


def metric(out, section, column, name):
    found = [r for r in out if (r["section"], r["column"], r["metric"]) == (section, column, name)]
    assert len(found) == 1
    return found[0]["text"] if found[0]["value"] is None else found[0]["value"]


def test_sections_and_suggestions(spark, table):
    out = G.full_report(table, Catalogue.from_dict(SPEC)).collect()
    assert metric(out, "label", "label_type", "neg_per_pos") == 29.0
    assert metric(out, "scalar", "user_int_feats_1", "p50") == 30.5
    assert metric(out, "missing", "item_int_feats_4", "missing_count") == 40.0
    assert metric(out, "correlation", "user_int_feats_1/user_int_feats_2", "pearson") == 1.0
    assert metric(out, "outliers", "item_int_feats_4", "severity") == "severe"
    assert metric(out, "array", "user_int_feats_3", "max_dim") == 2.0
    assert metric(out, "domain_coverage", "b", "with_seq") == 10.0
    assert metric(out, "seq_length", "a", "max_raw_len") == 2.0
    assert metric(out, "vocab", "b_seq_2", "note") == "timestamp"
    assert metric(out, "timestamp", "a_seq_2", "declared") == 0.0
    assert metric(out, "overlap", "a/b", "overlap") == 1.0
    advice = {(r["metric"], r["column"]) for r in out if r["section"] == "suggestions"}
    assert advice == {
        ("imbalance", "label_type"), ("missing", "item_int_feats_4"), ("low_coverage", "b"),
        ("correlated", "user_int_feats_1/user_int_feats_2"), ("outliers", "item_int_feats_4"),
        ("undeclared_timestamp", "a_seq_2"),
    }


def test_nothing_to_suggest(spark):
    empty = spark.createDataFrame([], "section string, column string, metric string, value double, text string")
    assert rows(G.suggestions(empty)) == [("ok", None, None)]


def test_run_analysis(spark, table, tmp_path):
    (tmp_path / "schema.json").write_text(json.dumps(SPEC))
    table.orderBy("user_id").coalesce(1).write.parquet(str(tmp_path / "data"))
    out = str(tmp_path / "out")
    G.run_analysis(spark, str(tmp_path / "data"), str(tmp_path / "schema.json"), out, max_rows=40, export_rows=15)
    report = spark.read.json(f"{out}/report").collect()
    assert metric(report, "label", "label_type", "total") == 40.0
    assert sorted(r["user_id"] for r in spark.read.parquet(f"{out}/first_15").collect()) == list(range(15))
