"""Documents in, answers out: pages and images to a searchable corpus, and questions to answers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import storage
from folio.operators import answer, captions, images, outline, pages, plugins, search
from folio.operators import replies as asking
from folio.plans.index import Index
from folio.plans.metrics import Metrics

KEY = ["query_id", "doc_id"]


@dataclass(frozen=True)
class Corpus:
    """sections: outline.outline(); images: with captions and labels; claims: which section has an image. All keyed by doc_id.

    ingest() gives plans, which every step of a search reads anew: take stored() before questions are asked.
    """

    sections: DataFrame
    images: DataFrame
    claims: DataFrame

    def written(self, path: str) -> Corpus:
        """The corpus as tables in path; claims are made from the tables."""
        spark = self.sections.sparkSession
        for name in ("sections", "images"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        claims(*(spark.read.parquet(f"{path}/{name}") for name in ("sections", "images"))).write.mode("overwrite").parquet(f"{path}/claims")
        return read(spark, path)

    def stored(self) -> Corpus:
        """The corpus as tables in the shared folder, which go with the session; claims are made from the tables."""
        sections, images_ = storage.written(self.sections, "sections"), storage.written(self.images, "images")
        return Corpus(sections, images_, claims(sections, images_))


def read(spark: SparkSession, path: str) -> Corpus:
    """A corpus that written() has left in path."""
    return Corpus(*(spark.read.parquet(f"{path}/{name}") for name in ("sections", "images", "claims")))


def ingest(page_table: DataFrame, image_table: DataFrame, tail_policy: str = "reference") -> Corpus:
    """Pages (doc_id, page, md) and images (doc_id, page, img_pos, b64, b64_len) as a corpus.

    Captions are mined and matched with images, put before the text of their pages, and the pages, one text per document,
    become an outline whose sections claim the images of their pages. Sections and images both read the captions, which are
    stored when this is called; the files go with the session.
    """
    own = pages.normal(page_table)
    matched = captions.matched(image_table, storage.written(captions.mined(own), "captions"))
    lines = pages.lines(pages.assembled(own, captions.lines(matched)))
    sections = outline.outline(lines, tail_policy)
    return Corpus(sections, matched, images.claimed(sections, matched))


def from_trees(trees: DataFrame) -> Corpus:
    """Trees (doc_id, tree) of nested sections as a corpus: questions are asked of what another program, or nested(), has written."""
    sections, pictures = outline.unnested(trees)
    pictures = storage.written(pictures, "pictures")
    return Corpus(sections, pictures.drop("seq"), pictures.select("doc_id", "page", "img_pos", "seq"))


def claims(sections: DataFrame, image_table: DataFrame) -> DataFrame:
    """Which section has which image."""
    return images.claimed(sections, image_table)


def entries(corpus: Corpus) -> DataFrame:
    return search.index_entries(corpus.sections, corpus.claims)


def find(
    corpus: Corpus, questions: DataFrame, ranker: plugins.NodeRanker | None = None, replies: DataFrame | None = None,
    timeout: float = plugins.TIMEOUT, log: str | None = None, index: Index | None = None,
) -> DataFrame:
    """(query_id, doc_id, seq, via): the sections of each question, by figure, by a ranker or its replies (query_id, doc_id, raw), or by BM25.

    A ranker is asked once for each prompt, before anything reads its replies; log keeps them, so that a later call with the
    same prompts asks only what is missing. index is a stored one of the corpus.
    """
    named = storage.written(search.figure_hits(questions, corpus.sections), "named")
    if ranker is not None:
        prompts = search.navigation_prompts(questions.join(named.select(*KEY), KEY, "left_anti"), entries(corpus))
        replies = asking.asked(prompts, ranker, log, timeout)
    if replies is not None:
        replies = storage.written(replies.select(*KEY, search.parsed_reply(F.col("raw"))["node_list"].alias("node_list")), "node-lists")
    return search.cascade(questions, corpus.sections, replies, named, index.postings() if index else None)


def retrieve(corpus: Corpus, questions: DataFrame, ranker: plugins.NodeRanker | None = None, replies: DataFrame | None = None, metrics: Metrics | None = None, **options) -> DataFrame:
    """The sections of each question, with their contents, kept in the shared folder: context, citations, images and answer all read them.

    metrics counts, as "found", the sections by the way they were found.
    """
    hits = find(corpus, questions, ranker, replies, **options)
    if metrics:
        hits = metrics.watch("found", hits, **{way: F.count_if(F.col("via") == way) for way in ("figure", "ranker", "bm25")})
    return storage.written(search.retrieved(storage.written(hits, "hits"), questions, corpus.sections), "found")


def ask(
    corpus: Corpus, questions: DataFrame, ranker: plugins.NodeRanker | None = None, replies: DataFrame | None = None,
    answerer: plugins.Answerer | None = None, log: str | None = None, timeout: float = plugins.TIMEOUT, index: Index | None = None,
    metrics: Metrics | None = None,
) -> DataFrame:
    """(query_id, doc_id, prompt, images, answer, sources) of each question (query_id, doc_id, query) on its document.

    images are the payloads sent along, sources the citations in order. Without an answerer the answer is the extract that
    fits best, and no model is asked; with one there is a column error, null where it answered. log is the folder of both
    models' replies, in which a job that starts again finds what it need not ask.
    """
    found = retrieve(corpus, questions, ranker, replies, metrics, timeout=timeout, log=log and f"{log}/ranker", index=index)
    sent = storage.written(answer.attached(questions, found, corpus.images, corpus.claims, corpus.sections), "attached")
    payloads = sent.join(corpus.images.select("doc_id", "page", "img_pos", "b64"), ["doc_id", "page", "img_pos"]).select(*KEY, F.expr("array_repeat(b64, cast(copies as int))").alias("images"))
    rows = answer.prompts(questions, found).join(payloads, KEY, "left").withColumn("images", F.coalesce("images", F.array().cast("array<string>")))
    if answerer:
        rows = storage.written(rows, "asking")
        told = asking.asked(rows.select(*KEY, "prompt", "images"), answerer, log and f"{log}/answerer", plugins.ANSWER_TIMEOUT).select(*KEY, F.col("raw").alias("answer"), "error")
    else:
        told = answer.extracts(questions, found)
    return rows.join(told, KEY).select(*KEY, "prompt", "images", "answer", F.split("sources", "; (?=Section: ')").alias("sources"), *(["error"] if answerer else []))
