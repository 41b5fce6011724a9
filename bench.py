"""Times the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from timberline import catalog

QUERIES = ("profile_orders", "bins_quantile", "hist_root", "hist_level", "best_split_missing", "goss_select", "auc", "aucpr", "ctr_borders", "folds_stratified", "gbdt_depthwise", "gbdt_lossguide", "gbdt_symmetric", "forest", "linear_fit", "tree_shap")


#: Trees of the fit at the settings that single-machine trainers are measured by: depth 6, 256 bins.
TREES = int(os.environ.get("BENCH_TREES", "3"))


def depth6(spark: SparkSession, sf_dir: str):
    from timberline.plans import boost, model

    d = catalog.training_rows(spark, sf_dir)
    kinds = {c: "numeric" for c in ("quantity", "discount", "tax", "line")}
    m = boost.train(d, kinds, "late", boost.BoostParams(TREES, tree=boost.TreeParams(max_depth=6)))
    return model.predict(d, m, ["row_id"])


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    small, took = os.path.join(os.path.dirname(sf_dir), "sf0.001"), {}
    runs = {name: catalog.QUERIES[name] for name in QUERIES} | {f"gbdt_depth6_{TREES}_trees": depth6}
    for name, run in runs.items():
        if os.path.isdir(small):  # compiles code
            run(spark, small).write.format("noop").mode("overwrite").save()
            spark.catalog.clearCache()
        began = time.time()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
