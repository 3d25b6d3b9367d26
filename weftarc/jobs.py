"""Jobs on the command line: ``python -m weftarc.jobs NAME input output [options]``.

A job reads a listing of archives (or what its help says), and saves a table. JOBS maps names to specifications; a new
job is a function from records to a DataFrame with register().
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftarc import sinks
from weftarc.functions import tld
from weftarc.metrics import Counters
from weftarc.operators import counts, files, graph, index, links, sitemaps, wet
from weftarc.session import build
from weftarc.sources import archives, tables

log = logging.getLogger("weftarc")


@dataclass(frozen=True)
class Job:
    """``run`` saves its table and gives counts; ``arguments`` adds options; partitions are the defaults of the two options."""

    run: Callable[[argparse.Namespace, SparkSession], dict]
    arguments: Callable[[argparse.ArgumentParser], None] = lambda p: None
    inputs: int = 400
    outputs: int = 10
    help: str = ""


JOBS: dict[str, Job] = {}


def pair(text: str) -> tuple[str, str]:
    name, equals, value = text.partition("=")
    if not equals:
        raise argparse.ArgumentTypeError(f"name=value is expected: {text}")
    return name, value


def save(a: argparse.Namespace, df: DataFrame, name: str | None = None) -> None:
    sinks.table(df, name or a.output, a.num_output_partitions, a.output_format, a.output_compression, **dict(a.output_option))


def _read(a: argparse.Namespace, spark: SparkSession, *types: str) -> Counters:
    """The records, of these types if any, of the files of a listing in any store."""
    files = archives.manifest(spark, a.input, 1)
    return Counters(archives.listed(spark, a.input, a.input_base_url, a.num_input_partitions, list(types) or None), files)


def register(name: str, f: Callable[[DataFrame], DataFrame], *types: str, help: str = "", seen: Callable[[Counters], DataFrame] | None = None, **more) -> None:
    """A job that saves what f makes of the records of a listing; types: the record types that f needs; seen: f with counts of its own."""

    def run(a: argparse.Namespace, spark: SparkSession) -> dict:
        c = _read(a, spark, *types)
        save(a, seen(c) if seen else f(c.records))
        return c.values()

    JOBS[name] = Job(run, help=help, **more)


register("server_count", counts.server_count, "response", "metadata", help="server names")
register("server_ip", counts.server_ip_count, "response", "metadata", help="hosts and addresses")
register("tag_count", counts.tag_count, "response", help="HTML tags")
register("word_count", counts.word_count, "conversion", help="words of text archives")
register(
    "sitemaps", sitemaps.sitemaps, "response", help="sitemaps of robots.txt files",
    seen=lambda c: sitemaps.of_files(c.also(sitemaps.announced(c.records), *sitemaps.counted())),
)


def _links(to_pairs: Callable[[DataFrame], DataFrame]):
    """to_pairs: the links of the rows that captures() gives, before equal ones are one."""

    def run(a: argparse.Namespace, spark: SparkSession) -> dict:
        seen: dict = {}
        if a.input:
            c = _read(a, spark, "response", "metadata")
            pairs = c.also(to_pairs(links.captures(c.records)), F.count(F.lit(1)).alias("link_count")).distinct()
            if a.intermediate_output:
                save(a, pairs, a.intermediate_output)
                seen, pairs = c.values(), spark.table(a.intermediate_output)
        elif a.intermediate_output:
            pairs = spark.table(a.intermediate_output)
        else:
            raise SystemExit("give an input, or an intermediate output to go on from")
        sinks.edges(pairs, a.output, a.num_output_partitions, format=a.output_format, compression=a.output_compression, **dict(a.output_option))
        return seen or (c.values() if a.input else {})

    return run


def _intermediate(p: argparse.ArgumentParser) -> None:
    p.add_argument("--intermediate_output", help="table of the pairs as they were found; with an empty input, go on from it")


JOBS["page_links"] = Job(_links(links.page_links_of), _intermediate, help="links between pages")
JOBS["host_links"] = Job(_links(links.host_links_of), _intermediate, 32, 16, "links between hosts")


def _graph_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("--save_as_text", help="folder for vertices and edges as tab-separated lines")
    p.add_argument("--normalize_host_names", action="store_true")
    p.add_argument("--validate_host_names", action="store_true")
    p.add_argument("--tld_list", help="file of top-level domains, one a line; else a rule")
    p.add_argument("--vertex_partitions", type=int, default=None)
    p.add_argument("--vertex_ids", help="table of vertices: used if it exists, else made")
    p.add_argument("--add_input", action="append", default=[])


def _host_graph(a: argparse.Namespace, spark: SparkSession) -> dict:
    edges = tables.edges(spark, a.input, *a.add_input)
    options = {"normalize": a.normalize_host_names, "validate": a.validate_host_names, "tlds": tld.table(spark, a.tld_list), "partitions": a.vertex_partitions}
    if a.vertex_ids:
        ids = graph.load_or_make_ids(edges, a.vertex_ids, **options)
    else:
        save(a, graph.vertices(edges, **options), f"{a.output}_vertices")
        ids = spark.table(f"{a.output}_vertices")
    joined = graph.edges_of_ids(edges, ids).coalesce(a.num_output_partitions).sortWithinPartitions("s", "t")
    save(a, joined, f"{a.output}_edges")
    if a.save_as_text:
        sinks.tsv(ids, f"{a.save_as_text}/vertices", "id", "name")
        sinks.tsv(spark.table(f"{a.output}_edges"), f"{a.save_as_text}/edges", "s", "t")
    return {}


JOBS["host_graph"] = Job(_host_graph, _graph_arguments, outputs=16, help="vertices and edges of a table of host links")


def _link_map(a: argparse.Namespace, spark: SparkSession) -> dict:
    sinks.edges(tables.tsv_edges(spark, a.input).coalesce(a.num_input_partitions), a.output, a.num_output_partitions, format=a.output_format, compression=a.output_compression, **dict(a.output_option))
    return {}


def _md5(a: argparse.Namespace, spark: SparkSession) -> dict:
    save(a, files.md5(tables.files(spark, a.input).coalesce(a.num_input_partitions)))
    return {}


def _wet(a: argparse.Namespace, spark: SparkSession) -> dict:
    listed = archives.manifest(spark, a.input, a.num_input_partitions)
    made = wet.extract(listed, a.output_base_url, a.input_base_url, a.html_parser, skip=not a.overwrite, temp=a.local_temp_dir)
    c = Counters(spark.createDataFrame([], archives.DDL))
    n = lambda x, name: F.coalesce(F.sum(x.cast("int")), F.lit(0)).cast("long").alias(name)
    skipped = F.col("error") == wet.EXISTS
    failed = F.col("error").isNotNull() & ~skipped
    save(a, c.also(made, n(F.col("wet_record_location").isNotNull(), "wet_records_written"), n(failed, "warc_input_failed"), n(skipped, "warc_input_skip_output_exists")).filter(F.col("error").isNull() | failed))
    seen = c.seen[-1].get
    return seen | {"warc_input_processed": listed.count() - seen["warc_input_failed"] - seen["warc_input_skip_output_exists"]}


def _output_folder(p: argparse.ArgumentParser) -> None:
    p.add_argument("--output_base_url", required=True, help="folder that all executors share")
    p.add_argument("--html_parser", choices=("strip", "layout"), default="layout")
    p.add_argument("--overwrite", action="store_true", help="also write files that exist; else these are skipped")


JOBS["link_map"] = Job(_link_map, outputs=16, help="edges of tab-separated lines")
JOBS["md5"] = Job(_md5, help="checksums of files")
JOBS["wet"] = Job(_wet, _output_folder, help="text archives of WARC files")


def _index_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("--table", default="ccindex", help="name of the view of the index")
    p.add_argument("--query", help="Spark SQL over the view")
    p.add_argument("--table_schema", help="file with the JSON of a StructType")


def _record_arguments(p: argparse.ArgumentParser) -> None:
    _index_arguments(p)
    p.add_argument("--csv", action="store_true", help="the input is CSV with the places of records")
    p.add_argument("--input_table_format", help="the input is a table of places in this format")
    p.add_argument("--input_table_option", action="append", type=pair, default=[])
    p.add_argument("--html_parser", choices=("strip", "layout"), default="strip")


def _rows(a: argparse.Namespace, spark: SparkSession) -> DataFrame:
    if a.query:
        schema = open(a.table_schema).read() if a.table_schema else None
        df = index.query(spark, a.input, a.query, a.table, schema)
        df.explain()
        return df
    return tables.coordinates(spark, a.input, a.input_table_format, a.csv, **dict(a.input_table_option))


def _index_export(a: argparse.Namespace, spark: SparkSession) -> dict:
    if not a.query:
        raise SystemExit("--query is needed")
    options = {"compression": a.output_compression} | dict(a.output_option)
    return {"rows": index.export(_rows(a, spark), a.output, a.num_output_partitions, a.output_format, **options)}


def _index_words(a: argparse.Namespace, spark: SparkSession) -> dict:
    if bool(a.query) + a.csv + bool(a.input_table_format) != 1:
        raise SystemExit("give one of --query, --csv and --input_table_format")
    c = Counters(index.records(_rows(a, spark), a.input_base_url, a.num_input_partitions))
    save(a, counts.word_frequencies(c.also(counts.html_texts(c.records, a.html_parser), *counts.parse_counts())))
    return c.values()


JOBS["index_export"] = Job(_index_export, _index_arguments, help="the result of a query over a URL index")
JOBS["index_word_count"] = Job(_index_words, _record_arguments, help="words of the pages that an index gives the places of")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftarc", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = top.add_subparsers(dest="job", required=True)
    for name, job in JOBS.items():
        p = jobs.add_parser(name, help=job.help)
        p.add_argument("input")
        p.add_argument("output")
        p.add_argument("--input_base_url")
        p.add_argument("--num_input_partitions", type=int, default=job.inputs)
        p.add_argument("--num_output_partitions", type=int, default=job.outputs)
        p.add_argument("--output_format", default="parquet")
        p.add_argument("--output_compression", default="gzip")
        p.add_argument("--output_option", action="append", type=pair, default=[])
        p.add_argument("--local_temp_dir", help="for files under way, where a job has any")
        p.add_argument("--log_level", default="INFO", choices=("CRITICAL", "ERROR", "WARNING", "INFO", "DEBUG"))
        p.add_argument("--spark-profiler", action="store_true", help="profile Python functions")
        job.arguments(p)
    return top


def run(arguments: list[str], spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(arguments)
    logging.basicConfig(level=a.log_level)
    spark = spark or build(f"weftarc {a.job}")
    if a.spark_profiler:
        spark.conf.set("spark.sql.pyspark.udf.profiler", "perf")
    seen = JOBS[a.job].run(a, spark)
    log.info("%s: %s", a.job, json.dumps(seen))
    if a.spark_profiler:
        spark.profile.show(type="perf")
    return seen


if __name__ == "__main__":
    run(sys.argv[1:])
