"""Command lines: python -m lectern.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions.annotate import annotate
from lectern.operators import known, profile, summaries, vocabulary
from lectern.plans import services
from lectern.sources import articles as S


def _input(spark: SparkSession, args) -> DataFrame:
    """Annotated articles of --text, --file, --dataset with --id, or all of --dataset, or of the default batch file."""
    if args.text:
        return annotate(services.one_article(spark, args.text))
    if args.file:
        return annotate(S.read_whole_text(spark, args.file))
    rows = S.read_failing(spark, args.dataset or args.input)
    return S.point_lookup(rows, args.id) if args.id else rows.limit(args.limit) if getattr(args, "limit", 0) else rows


def _put(df: DataFrame, output: str | None) -> None:
    if output:
        S.write_jsonl(df, output)
    else:
        for line in df.toJSON().toLocalIterator():
            print(line)


def _show(df: DataFrame, n: int) -> None:
    """The first n records by place in their file, one object a line, on the terminal."""
    if n > 0:
        for line in S.first_records(df, n).drop(S.POSITION).toJSON().collect():
            print(line)


def _split_of(path: str) -> str:
    """The split that a file's name gives away."""
    name = os.path.basename(path.rstrip("/")).lower()
    return next((s for s in ("test", "train") if s in name), "validation")


def _sources(p: argparse.ArgumentParser, *, exclusive: bool = False) -> None:
    """Where articles come from; if exclusive, exactly one of a text, a file, a dataset's record and a whole batch."""
    of = p.add_mutually_exclusive_group(required=True) if exclusive else p
    of.add_argument("--text", "--article")
    of.add_argument("--file", "--article-file")
    of.add_argument("--dataset")
    of.add_argument("--batch", action="store_true")
    p.add_argument("--id")
    p.add_argument("--input", default="annotated.jsonl")
    p.add_argument("--output")
    p.add_argument("--limit", type=int, default=0)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lectern")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("sample", help="a seeded sample of valid raw articles")
    for name, kind, default in (("--input", str, None), ("--samples", int, 100), ("--seed", int, 42)):
        p.add_argument(name, type=kind, default=default)
    p.add_argument("--split", choices=("train", "validation", "test"), default="test", help="with an --input that holds {split}, the part to read")
    to = p.add_mutually_exclusive_group(required=True)
    to.add_argument("--output")
    to.add_argument("--output-dir", help="folder that gets articles_SPLIT_SAMPLES")
    p.add_argument("--shuffle", action="store_true")
    p = sub.add_parser("explore", help="validation and profile")
    for name in ("--input", "--output-json", "--output-md"):
        p.add_argument(name)
    p.add_argument("--num-samples-display", type=int, default=3)
    p = sub.add_parser("annotate")
    for name in ("--input", "--output", "--stats-json", "--report-md"):
        p.add_argument(name)
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--samples-to-show", type=int, default=5)
    for method in summaries.METHODS:
        p = sub.add_parser(method)
        _sources(p, exclusive=method == "tfidf")
        p.add_argument("-k", "--num-sentences", "--sentences", dest="k", type=int, default=3)
        if method == "tfidf":
            p.add_argument("--smooth-idf", action="store_true")
        if method == "textrank":
            for name, kind, default in (("--damping", float, 0.85), ("--iterations", int, 100), ("--tolerance", float, 1e-6)):
                p.add_argument(name, type=kind, default=default)
    p = sub.add_parser("vocabulary")
    _sources(p)
    p.add_argument("--max-items", type=int, default=30)
    p.add_argument("--no-entities", action="store_true")
    p = sub.add_parser("detect")
    for name in ("--input", "--output", "--known-file", "--known", "--id"):
        p.add_argument(name)
    p = sub.add_parser("evaluate")
    for name in ("--references", *(f"--{m}" for m in summaries.METHODS), "--output-json", "--output-articles"):
        p.add_argument(name)
    return top


def main(argv: list[str] | None = None) -> None:
    top = parser()
    args = top.parse_args(argv)
    if args.command == "tfidf" and args.dataset and not args.id:
        top.error("--dataset needs --id; --batch with --input takes all records")
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    if args.command == "sample":
        rows = S.read_strict(spark, args.input.replace("{split}", args.split))
        output = args.output or f"{args.output_dir.rstrip('/')}/articles_{args.split}_{args.samples}"
        S.write_jsonl(S.trimmed(profile.valid_rows(S.sample(rows, args.samples, args.seed, args.shuffle))).drop(S.POSITION), output)
    elif args.command == "explore":
        rows = S.read_strict(spark, args.input)
        valid = profile.valid_rows(rows)
        joined = profile.validation(rows).crossJoin(profile.profile(valid).withColumnRenamed("articles", "profiled"))
        joined = joined.withColumns({"split": F.lit(_split_of(args.input)), "seed": F.lit(42)})
        report = S.write_report(joined, args.output_json) if args.output_json else json.loads(joined.toJSON().first())
        if args.output_md:
            with open(args.output_md, "w", encoding="utf-8") as f:
                f.write(S.markdown("Corpus profile", report))
        _show(valid.select("article", "highlights", S.POSITION), args.num_samples_display)
    elif args.command == "annotate":
        rows = S.read_failing(spark, args.input, schemas.RAW_ARTICLE)
        made = annotate(rows.limit(args.limit) if args.limit else rows)
        S.write_jsonl(made, args.output)
        stats = profile.annotation_profile(spark.read.schema(schemas.ANNOTATED).json(args.output))
        report = S.write_report(stats, args.stats_json) if args.stats_json else {}
        if args.report_md:
            with open(args.report_md, "w", encoding="utf-8") as f:
                f.write(S.markdown("Annotation", report))
        if args.samples_to_show > 0:
            for line in spark.read.text(args.output).limit(args.samples_to_show).toLocalIterator():
                print(line.value)
    elif args.command in summaries.METHODS:
        options = {"smooth": args.smooth_idf} if args.command == "tfidf" else {"damping": args.damping, "iterations": args.iterations, "tolerance": args.tolerance} if args.command == "textrank" else {}
        _put(summaries.summarize(_input(spark, args), args.command, args.k, **options), args.output)
    elif args.command == "vocabulary":
        _put(vocabulary.extract(_input(spark, args), vocabulary.Options(max_items=args.max_items, include_entities=not args.no_entities)), args.output)
    elif args.command == "detect":
        words = known.known_words(spark, (args.known or "").split(","))
        words = words.union(known.read_known(spark, args.known_file)) if args.known_file else words
        if words.isEmpty():
            print("warning: no known words, so every item is new")
        rows, _ = S.read_lenient(spark, args.input, schemas.VOCABULARY)
        found = known.detect(rows.where(rows.article_id == args.id) if args.id else rows, words)
        _put(found, args.output)
    else:
        read = lambda path, ddl: S.read_strict(spark, path, ddl)
        tables = {m: read(getattr(args, m), "id STRING, article_id STRING, summary STRING") for m in summaries.METHODS}
        out = services.evaluate_files(read(args.references, schemas.REFERENCE), tables)
        if args.output_articles:
            S.write_jsonl(out["articles"], args.output_articles)
        report = {k: [json.loads(x) for x in out[k].toJSON().collect()] for k in ("stats", "winners", "best", "words")}
        print(json.dumps(report, indent=2) if not args.output_json else args.output_json)
        if args.output_json:
            with open(args.output_json, "w", encoding="utf-8") as f:
                json.dump(report, f, indent=2)


if __name__ == "__main__":
    main()
