import json

import pytest
from helpers import rows

from clickloom import catalogue as C

SPEC = {
    "user_int": [[1, 5, 1], [15, 20, 3], [3, 0, 1]],
    "item_int": [[5, 326, 1]],
    "user_dense": [[61, 4], [62, 2]],
    "seq": {
        "seq_b": {"prefix": "domain_b_seq", "ts_fid": None, "features": [[68, 28], [69, 143233600]]},
        "seq_a": {"prefix": "domain_a_seq", "ts_fid": 39, "features": [[38, 1201293], [39, 1772725488], [40, 19]]},
    },
}


@pytest.fixture()
def cat():
    return C.Catalogue.from_dict(SPEC, {"seq_a": 10})


def test_load(spark, tmp_path):
    path = tmp_path / "schema.json"
    path.write_text(json.dumps(SPEC, indent=1))
    cat = C.load_catalogue(spark, str(path), "seq_a:10, seq_b:512")
    assert cat.domains == ["seq_a", "seq_b"]
    assert [f.column for f in cat.side_info("seq_a")] == ["domain_a_seq_38", "domain_a_seq_40"]
    assert cat.ts_feature("seq_a").fid == 39 and cat.ts_feature("seq_b") is None
    assert cat.max_len("seq_a") == 10 and cat.max_len("seq_b") == 512
    assert C.Catalogue.from_dict(SPEC).max_len("seq_a") == 256
    assert cat.width("user_int") == 5 and cat.width("user_dense") == 6
    assert cat.to_df(spark).count() == 11


def test_offsets(spark, cat):
    got = {r["column"]: r["offset"] for r in C.feature_offsets(cat.to_df(spark).filter("group = 'user_int'")).collect()}
    assert got == {"user_int_feats_1": 0, "user_int_feats_15": 1, "user_int_feats_3": 4}


def test_groups(spark, cat):
    config = {"_note": "x", "user_ns_groups": {"U1": [15, 1]}, "item_ns_groups": {"I1": [5]}}
    assert rows(C.feature_groups(spark, cat, config), "name", "pos", "fid") == [("I1", 0, 5), ("U1", 0, 15), ("U1", 1, 1)]
    assert C.feature_groups(spark, cat, None).count() == 4
    with pytest.raises(KeyError, match="99"):
        C.feature_groups(spark, cat, {"user_ns_groups": {"U1": [99]}, "item_ns_groups": {}})


def test_virtual_id_table_size(spark):
    spec = {
        "user_int": [[i, 100, 1] for i in range(35)] + [[90, 10, 4]],
        "item_int": [[i, 100, 1] for i in range(13)],
    }
    df = C.Catalogue.from_dict(spec).to_df(spark)
    sizes = {r["group"]: r["table_size"] for r in C.virtual_id_bases(df, 32).collect()}
    assert sizes == {"user_int": 1156, "item_int": 430}
    bases = [r["base"] for r in C.virtual_id_bases(df, 32, 3).filter("group = 'user_int'").orderBy("token").collect()]
    assert bases == [1, 34, 67]
    by_vocab = C.virtual_id_bases(df, None).filter("group = 'item_int'").orderBy("token").collect()
    assert [r["base"] for r in by_vocab[:2]] == [1, 102] and by_vocab[0]["table_size"] == 13 * 101 + 1


def test_primary_field(spark, cat):
    got = {r["domain"]: (r["fid"], r["slot"]) for r in C.primary_field(cat.to_df(spark), 200_000).collect()}
    assert got == {"seq_a": (40, 1), "seq_b": (68, 0)}
    none = C.primary_field(cat.to_df(spark), 5).collect()
    assert len(none) == 2 and all(r["fid"] is None for r in none)


def test_vocab_gate(spark, cat):
    got = {r["column"]: (r["skipped"], r["is_id"]) for r in C.vocab_gate(cat.to_df(spark), 1_000_000, 10_000).collect()}
    assert got["user_int_feats_3"] == (True, False)
    assert got["domain_a_seq_38"] == (True, True)
    assert got["user_int_feats_1"] == (False, False)
    off = {r["column"]: r["skipped"] for r in C.vocab_gate(cat.to_df(spark)).collect()}
    assert not off["domain_a_seq_38"] and off["user_int_feats_3"]
