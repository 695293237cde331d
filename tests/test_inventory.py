import importlib

from podium.inventory import INVENTORY


def test_every_inventory_entry_resolves():
    for op, ref in INVENTORY.items():
        mod, fn = ref.split(":")
        assert callable(getattr(importlib.import_module(mod), fn)), op


def test_feature_ablation_on_user_day_runs(spark):
    # one small study end to end over real data (sf0.001): feature groups from the names
    from pyspark.sql import functions as F
    from podium.plans import catalog as C
    from podium.plans import models as ML
    from podium.plans import studies as ST
    t = C._split_facts(spark, "/root/testdata/sf0.001")
    out = ST.feature_ablation(t, C.FEATURES, "label", ML.logreg_l2(),
                              groups={"percentiles": [r"^pct_"], "minutes": [r"_MP$"]}).collect()
    # dropping every feature ("no_percentiles") leaves nothing to fit, so that variant is skipped
    assert {r.variant for r in out} == {"baseline", "no_minutes"}
    assert all(r.n_runs == 1 for r in out)
