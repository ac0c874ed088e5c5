import datetime as dt

import pytest

from groundwork import config
from groundwork.operators import index as I


def test_settings():
    s = config.Settings(collection="azul-2", drop=("flavor",))
    assert s.index_key == config.Settings().index_key != config.Settings(size=800).index_key
    for bad in ({"collection": "Azul"}, {"size": 100, "overlap": 100}, {"prompt": "v9"}, {"decision": "ja"}, {"golden": "../x.json"}, {"top_k": 0}, {"drop": ("regel",)}, {"drop": ("unbekannt",)}):
        with pytest.raises(ValueError):
            config.Settings(**bad)
    assert config.drop_types(" Flavor, meta,flavor") == ("flavor", "meta") and config.drop_types(None) == ()
    t = dt.datetime(2024, 1, 1, 12)
    assert config.run_meta(s, t, t + dt.timedelta(seconds=90), 3)["sekunden"] == 90.0
    with pytest.raises(ValueError):
        config.run_meta(s, t, t - dt.timedelta(seconds=1), 3)


def test_older_layouts(spark):
    d = spark.createDataFrame([(1, "x")], "id int, text string")
    new = I.with_missing_columns(d, spark.createDataFrame([], "text string, buch_id string, id int").schema)
    assert new.columns == ["text", "buch_id", "id"] and new.first().buch_id is None
    assert I.migrated(d, "azul", "Azul").first().spiel_id == "azul"
    v = spark.createDataFrame([("s", [1.0]), ("s", [1.0, 2.0]), ("t", [1.0])], "s string, emb array<double>")
    assert [r.s for r in I.same_dimension(v, ["s"], "emb").collect()] == ["s"]
