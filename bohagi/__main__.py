"""Commands: python -m bohagi VERB ... over Parquet and JSON files."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _words(spark: SparkSession, a) -> int:
    from bohagi.plans import word_crops
    from bohagi.sources import writers

    writers.guard(a.output, a.overwrite)
    got = word_crops.prepare(spark.read.parquet(a.input), a.config)
    writers.write_dataset(got.pop("rows"), f"{a.output}/rows", a.overwrite)
    for name, df in got.items():
        writers.write_jsonl(df, f"{a.output}/{name}", a.overwrite)
    return 0


def _corpus(spark: SparkSession, a) -> int:
    from bohagi.operators.lines import corpus_lines
    from bohagi.sources import readers, writers

    writers.write_jsonl(corpus_lines(readers.read_articles(spark, a.input), a.max_lines), a.output, a.overwrite)
    return 0


def _evaluate(spark: SparkSession, a) -> int:
    from bohagi.operators.evaluation import evaluate_documents
    from bohagi.sources import readers, writers

    # documents of a folder are told apart by their files' names, the same on both sides; two single files are one document
    key = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1) if all(os.path.isdir(x) for x in (a.expected, a.predicted)) else F.lit("document")
    key = key.alias("doc")
    e, p = (readers.read_documents(spark, x).select(key, "pages") for x in (a.expected, a.predicted))
    for name, df in evaluate_documents(e, p, a.iou).items():
        print(name, *[writers.report(df)] if name != "layout_by_class" else [r.asDict() for r in df.collect()], sep="\n")
    return 0


def _bundle(spark: SparkSession, a) -> int:
    from bohagi.sources import readers, writers

    writers.manifest(readers.read_files(spark, a.input)).coalesce(1).write.mode("overwrite").json(a.output)
    return 0


def _release(spark: SparkSession, a) -> int:
    from bohagi.operators.audit import release_gates, released

    v = spark.read.json(a.metrics, multiLine=True)
    g = release_gates(v, {"cer": ("at_most", a.max_cer), "size_mb": ("at_most", a.max_size_mb), "ra_coverage": ("at_least", 100), "wa_coverage": ("at_least", 100)})
    for r in g.collect():
        print(r.asDict())
    return 0 if released(g).first()[0] else 1


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="bohagi")
    verbs = p.add_subparsers(required=True)

    def verb(name, run, *args):
        v = verbs.add_parser(name)
        v.set_defaults(run=run)
        for flags, kw in args:
            v.add_argument(*flags, **kw)

    io = ((("input",), {}), (("output",), {}), (("--overwrite",), {"action": "store_true"}))
    verb("prepare-words", _words, *io, (("--config",), {"default": "assamese"}))
    verb("prepare-corpus", _corpus, *io, (("--max-lines",), {"type": int}))
    verb("evaluate-document", _evaluate, (("expected",), {}), (("predicted",), {}), (("--iou",), {"type": float, "default": 0.5}))
    verb("bundle-manifest", _bundle, *io[:2])
    verb("check-release", _release, (("metrics",), {}), (("--max-cer",), {"type": float, "default": 0.03}), (("--max-size-mb",), {"type": float, "default": 15.0}))
    a = p.parse_args(argv)
    return a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
