"""python -m folio PAGES IMAGES [--kind KIND] (-q QUERY | -i) [--doc ID] [--model NAME --url URL --log FOLDER] | --export FOLDER | --images FOLDER"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from folio.config import Settings
from folio.errors import IngestionError
from folio.operators.plugins import ChatClient
from folio.plans import engine
from folio.sources import formats
from folio.sources import pages as source

IMAGES = "doc_id BIGINT, page BIGINT, img_pos BIGINT, b64 STRING, b64_len BIGINT"


def answered(corpus: engine.Corpus, spark: SparkSession, docs: DataFrame, query: str, client: ChatClient | None, settings: Settings) -> None:
    """Prints the answer and the sources of a question for each document."""
    questions = docs.selectExpr("doc_id AS query_id", "doc_id").crossJoin(spark.createDataFrame([(query,)], "query STRING"))
    for row in engine.ask(corpus, questions, client and client.ranker(), None, client and client.answerer(), settings.log, settings.timeout).orderBy("doc_id").toLocalIterator():
        print(f"[{row['doc_id']}] {row['answer'] if row['answer'] is not None else 'no answer: ' + row['error']}", *(f"  - {x}" for x in row["sources"]), sep="\n")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folio", description=__doc__)
    parser.add_argument("pages")
    parser.add_argument("images", nargs="?")
    parser.add_argument("--kind", default="parquet")
    parser.add_argument("--doc", type=int)
    parser.add_argument("--model")
    parser.add_argument("--url")
    parser.add_argument("--log")
    what = parser.add_mutually_exclusive_group(required=True)
    what.add_argument("-q", "--query")
    what.add_argument("-i", "--interactive", action="store_true")
    what.add_argument("--export")
    what.add_argument("--images", dest="pictures")
    own = parser.parse_args(argv)
    settings = Settings.of(model=own.model, url=own.url, log=own.log)
    spark = SparkSession.builder.getOrCreate()
    try:
        table = source.read_pages(spark, own.pages, own.kind)
    except IngestionError as error:
        print(error, file=sys.stderr)
        return 1
    if own.doc is not None:
        table = table.where(f"doc_id = {own.doc}")
    if own.export:
        source.write_texts(table, own.export)
        return 0
    client = settings.client()
    if client and not client.is_available():
        print(f"no model answers at {settings.url}", file=sys.stderr)
        return 1
    images = source.read_images(spark, own.images) if own.images else spark.createDataFrame([], IMAGES)
    corpus = engine.ingest(table, images, settings.tail_policy).stored()
    if own.pictures:
        told = formats.write_images(corpus.claims.join(corpus.images, ["doc_id", "page", "img_pos"]), own.pictures)
        print(f"{told.count()} images in {own.pictures}")
        return 0
    docs = table.select("doc_id").distinct()
    if own.query:
        answered(corpus, spark, docs, own.query, client, settings)
        return 0
    while True:
        try:
            query = input("> ").strip()
        except (EOFError, KeyboardInterrupt):
            return 0
        if query.lower() in ("exit", "quit", "/q"):
            return 0
        if query:
            answered(corpus, spark, docs, query, client, settings)


if __name__ == "__main__":
    sys.exit(main())
