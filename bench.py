"""Time headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "treatment_summary", "stand_density_plot", "plot_summary", "competition_larger", "top_height",
    "plot_and_species_totals", "species_shares_wide", "merchantable_volume", "crown_profile_average",
    "weevil_exact_codes", "overyielding_weighted", "transgressive_overyielding", "keep_first_by_key",
    "trees_with_stemform_and_site", "level_effects", "five_number_summary", "continuous_quantiles",
    "ols_by_species", "ols_logs", "boxcox_best", "height_curves_six_forms", "random_block_model",
    "weibull_diameter", "diameter_density", "treatment_pairs", "slope_and_aspect", "semivariogram",
    "occurrence_auc",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from standlab.plans import all_queries

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    named = all_queries()
    named["treatment_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        named[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
