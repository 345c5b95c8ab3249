"""Write the executed physical plans of the headline queries to PLANS.md.

    python tools/plans.py /root/testdata/sf0.1
"""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarry.plans.registry import all_entries  # noqa: E402
from quarry.session import get_spark  # noqa: E402

KEYS = ["ml_topn", "results_match_bag", "quota_sample", "extract_sql", "predicate_suite",
        "e2e_multijoin_count", "score_examples", "sse_frames"]
KEEP = re.compile(r"(Exchange|BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|HashAggregate|"
                  r"WindowGroupLimit|Window|Scan parquet|PushedFilters|ReadSchema|MapInPandas|"
                  r"TakeOrderedAndProject|ReusedExchange|AQEShuffleRead|Expand|Generate|"
                  r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|Scan ExistingRDD|InMemory|"
                  r"isFinalPlan|QueryStage)")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark()
    spark.sparkContext.setLogLevel("OFF")
    ents = all_entries()
    out = ["# Executed plans of the headline queries", "",
           f"Data: `{sf}`, local[8], AQE on. Generated by `tools/plans.py` after running each",
           "query in full; lines are the operators of the final adaptive plan.", ""]
    for k in KEYS:
        df = ents[k].build(spark, sf)
        df.collect()  # runs this DataFrame's own execution: its plan becomes final
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = [ln.rstrip() for ln in plan.splitlines() if KEEP.search(ln)]
        lines = [re.sub(r"#\d+L?", "", ln)[:160] for ln in lines]
        out += [f"## {k}", "", "```"] + lines[:60] + ["```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    print("wrote PLANS.md")


if __name__ == "__main__":
    main()
