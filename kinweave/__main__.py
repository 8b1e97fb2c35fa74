"""python -m kinweave build RELATIONSHIPS OUT | search OUT QUERY | path OUT FROM TO: builds the scored graph and its index from Parquet, and asks them."""
import sys

from pyspark.sql import SparkSession, functions as F

from .operators import edges, graph, paths, resolve, search
from .sources import sinks


def main(args: list[str]) -> int:
    if len(args) < 3 or args[0] not in ("build", "search", "path"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("kinweave").getOrCreate()
    if args[0] == "build":
        rel = spark.read.parquet(args[1])
        sinks.write_graph(edges.scored_edges(rel), f"{args[2]}/graph")
        scored = spark.read.parquet(f"{args[2]}/graph")
        degrees = graph.degree(scored)
        resolve.scored_index(degrees, graph.percentile(graph.pagerank(scored)), edges.display_names(rel)).write.mode("overwrite").parquet(f"{args[2]}/index")
    elif args[0] == "search":
        search.search(spark.read.parquet(f"{args[1]}/index"), " ".join(args[2:])).show(50, truncate=False)
    else:
        scored = spark.read.parquet(f"{args[1]}/graph")
        found = paths.find_paths(scored, args[2], args[3])
        paths.describe(found, scored).select("rank", "length", F.round("probability", 6).alias("probability"), F.col("path.label").alias("path")).orderBy("rank").show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
