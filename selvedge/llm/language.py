"""Language identification by Bayesian fusion of evidence.

For each row: how likely its text is in each language (naive Bayes over hashed byte trigrams, trained on a bounded sample of labelled texts, tempered because trigrams overlap), what its markup declares, what its address ends in, and what its host usually serves. The last three are learnt from all rows: their counts are sums of the text posteriors by grouped aggregation; a host's prior is smoothed by its domain's, a domain's by that of all rows. One class, "und", stands for text in none of the languages: every trigram is equally likely in it.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import batches_by_bytes, documents, ids_for_join, row_key, rows_at_most, unused, written
from .spans import LOWER, buffers, byte_class

UNKNOWN = "und"
#: The class of all labels beyond the CLASSES most frequent ones (the world's two-letter codes are fewer).
OTHER, CLASSES = "other", 200
#: Labelled texts that the text model is trained on (about so many of a larger table), so many of each label at least (all, where it has fewer), and hashed trigrams.
SAMPLE, LEAST, CELLS = 3000, 100, 1 << 14
#: A trigram counts as this share of an independent observation.
TEMPER = 0.2
#: Weight of a domain's prior in its hosts', and of the general one in its domains'.
PULL = 4.0
#: Pseudo-count of a declared language or an address suffix that a language hasn't been seen with.
UNSEEN = 0.5
#: Addresses are told apart by this many hashed suffixes, so their table has a bound.
SUFFIXES = 1 << 12

#: Letters in lower case (A-Z only); everything else a space.
LETTERS = np.where(byte_class((65, 90), (97, 122), (128, 255)), LOWER, 0x20).astype(np.uint8)
#: Elements whose content isn't the page's text, and what ends them.
OPENING = re.compile(r"(?i)<(?:(!--)|(script|style|nav|aside|footer|header)\b)")
CLOSING = {"!--": re.compile("-->"), **{name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "nav", "aside", "footer", "header")}}


def visible(markup: str | None) -> str:
    """The text of a page's body, without menus, scripts, comments and tags. What is opened and never closed counts as a tag alone. Each closing is sought from its opening on and, once there is none, never again, so the time is in proportion to the page's length."""
    markup = markup or ""
    parts, at, unclosed = [], 0, set()
    while (start := markup.find("<", at)) >= 0:
        opening, end = OPENING.match(markup, start), 0
        if opening and (name := (opening[1] or opening[2]).lower()) not in unclosed:
            closing = CLOSING[name].search(markup, opening.end())
            if closing:
                end = closing.end()
            else:
                unclosed.add(name)
        if not end:
            end = markup.find(">", start) + 1
            if not end:
                break
        parts.append(markup[at:start])
        at = end
    parts.append(markup[at:])
    return html.unescape(" ".join(parts))


#: The tag of the page's element, and the language among its attributes.
ROOT = re.compile(r"(?i)<html\b")
DECLARED = re.compile(r"""(?i)\blang\s*=\s*["']?([a-z]{2,3})""")


def declared_in(markup: str | None) -> str:
    """The primary part of the language that a page's first html tag declares, '' for none. The tag is read once, to its end or, unclosed, the page's."""
    markup = markup or ""
    root = ROOT.search(markup)
    if not root:
        return ""
    end = markup.find(">", root.end())
    found = DECLARED.search(markup, root.end(), end if end >= 0 else len(markup))
    return found[1].lower() if found else ""


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the letters of each text, without those with two spaces or more, and the n + 1 places where texts' begin."""
    data, offsets = buffers(column)
    data = LETTERS[data]
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    space = data == 0x20
    inside = np.ones(len(data) - 2, dtype=bool)
    for border in (offsets[1:-1] - 1, offsets[1:-1] - 2):  # a trigram that begins there crosses into the next text
        inside[border[(border >= 0) & (border < len(inside))]] = False
    inside &= (space[:-2].astype(np.uint8) + space[1:-1] + space[2:]) < 2
    at = np.flatnonzero(inside)
    code = data[:-2].astype(np.uint32) << 16 | data[1:-1].astype(np.uint32) << 8 | data[2:]
    cells = ((code * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int64)
    return cells[at], np.searchsorted(at, offsets)


@dataclass
class TextModel:
    """languages (UNKNOWN last) and log probabilities of the trigram cells in each."""

    languages: list[str]
    logs: np.ndarray

    def likelihoods(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihoods (text, language), and the number of trigrams of each text."""
        cells, begins = trigrams(column)
        out = np.empty((len(begins) - 1, len(self.languages)))
        for k in range(len(self.languages)):
            sums = np.concatenate(([0], np.cumsum(self.logs[k][cells], dtype=np.float64)))
            out[:, k] = sums[begins[1:]] - sums[begins[:-1]]
        return out * TEMPER, np.diff(begins)


def trained(docs: DataFrame, label: str = "lang") -> TextModel:
    """A text model from documents with a label. Its languages are the primary parts (tag()) of all labels of all documents, the CLASSES most frequent ones and OTHER at most; each is sampled at a rate of its own, SAMPLE's share but LEAST texts at least, chosen by a hash of doc_id and text. Without labelled texts, UNKNOWN is the only language."""
    known = documents(docs, tag(F.col(label).cast("string")).alias("language")).where("language <> ''")
    known = known.withColumn("place", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text"):
            cells, begins = trigrams(batch.column("text"))
            counted = [np.unique(cells[a:b], return_counts=True) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("language"), pa.array([x for x, _ in counted], pa.list_(pa.int32())), pa.array([x for _, x in counted], pa.list_(pa.int32()))], names=["doc_id", "language", "cells", "counts"])

    counts = known.groupBy("language").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    labels = counts.orderBy(F.desc("n"), "language").limit(CLASSES + 1).collect()
    if len(labels) > CLASSES:
        known = known.withColumn("language", F.when(F.col("language").isin(*[r["language"] for r in labels[:CLASSES]]), F.col("language")).otherwise(F.lit(OTHER)))
        labels = rows_at_most(known.groupBy("language").agg(F.count("*").alias("n"), F.min("place").alias("first")), CLASSES + 1)
    total = sum(r["n"] for r in labels)
    quota = {r["language"]: max(LEAST, math.ceil(SAMPLE * r["n"] / total)) for r in labels}
    # The row of the least place is in the sample whatever the rate.
    bounds = [(r["language"], max(int((1 << 30) * min(1.0, quota[r["language"]] / r["n"])), r["first"] + 1), 2 * quota[r["language"]]) for r in labels]
    bounds = docs.sparkSession.createDataFrame(bounds, "language string, bound long, most long")
    some = known.join(F.broadcast(bounds), "language").where("place < bound").select("doc_id", "text", "language")
    some = written(some.mapInArrow(run, "doc_id long, language string, cells array<int>, counts array<int>"), "sample")
    if some.count() > 2 * sum(quota.values()):  # a text that is repeated very often is chosen with all its rows
        order = Window.partitionBy("language").orderBy(F.xxhash64("doc_id", "cells"))
        some = some.join(F.broadcast(bounds), "language").withColumn("number", F.row_number().over(order)).where("number <= most").select("doc_id", "language", "cells", "counts")
    rows = some.toArrow().sort_by("doc_id").combine_chunks()
    languages = sorted(quota)
    counts = np.ones((len(languages) + 1, CELLS))
    for k, language in enumerate(languages):  # a trigram that a text repeats counts by the logarithm, lest a few texts make a language
        own = rows.filter(pc.equal(rows.column("language"), language))
        cells, seen = (pc.list_flatten(own.column(c)).to_numpy() for c in ("cells", "counts"))
        counts[k] += np.bincount(cells, np.log1p(seen), minlength=CELLS)
    counts[-1] = 1.0
    return TextModel([*languages, UNKNOWN], np.log(counts / counts.sum(1, keepdims=True)))


def softmax(logs: np.ndarray) -> np.ndarray:
    logs = np.exp(logs - logs.max(axis=1, keepdims=True))
    return logs / logs.sum(axis=1, keepdims=True)


def evidence(rows: DataFrame, model: TextModel, markup: bool) -> DataFrame:
    """id, host, domain, declared, suffix, n_trigrams, logs (tempered log likelihoods) and text_p (posterior of the text alone, all languages equal) from rows of id, content, host, domain, declared, suffix. With `markup`, content is a page, and what it declares is read from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "content"):
            column, declared = batch.column("content"), batch.column("declared")
            if markup:
                declared = pa.array([declared_in(x) for x in column.to_pylist()], pa.string())
                column = pa.array([visible(x) for x in column.to_pylist()], pa.large_string())
            logs, n = model.likelihoods(column)
            names = ["id", "host", "domain", "suffix"]
            lists = [pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel())) for x in (logs, softmax(logs))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], declared, pa.array(n, pa.int64()), *lists], names=[*names, "declared", "n_trigrams", "logs", "text_p"])

    return rows.mapInArrow(run, "id long, host string, domain string, suffix int, declared string, n_trigrams long, logs array<double>, text_p array<double>")


def _sums(k: int) -> Column:
    """The sums over rows of each place of text_p."""
    return F.array(*[F.sum(F.get("text_p", F.lit(i))) for i in range(k)])


def _added(column: str, k: int) -> Column:
    return F.array(*[F.sum(F.get(column, F.lit(i))) for i in range(k)])


def _total(column: str) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda a, x: a + x)


def _smoothed(own: str, above: str) -> Column:
    return F.zip_with(own, above, lambda x, p: (x + PULL * p) / (F.col(f"{own}_n") + PULL))


def priors(found: DataFrame, k: int) -> DataFrame:
    """host and prior (one for each language) of every host, from grouped sums: rows to hosts, hosts to domains, domains to one row."""
    hosts = found.groupBy("host", "domain").agg(_sums(k).alias("own")).withColumn("own_n", _total("own"))
    domains = hosts.groupBy("domain").agg(_added("own", k).alias("dom")).withColumn("dom_n", _total("dom"))
    all_ = domains.agg(_added("dom", k).alias("all_")).first()["all_"]  # one number for each language
    all_ = [x or 0.0 for x in all_]
    general = domains.withColumn("general", F.array(*[F.lit((x + 1.0) / (sum(all_) + k)) for x in all_]))
    smoothed = general.select("domain", _smoothed("dom", "general").alias("domain_prior"))
    return hosts.join(smoothed, "domain").select("host", "domain", _smoothed("own", "domain_prior").alias("prior"))


def likelihood_table(found: DataFrame, column: str, k: int) -> DataFrame:
    """For each value of an evidence column: log of its share among the rows of each language."""
    sums = found.groupBy(column).agg(_sums(k).alias("own"))
    whole = sums.agg(_added("own", k).alias("total"), F.count("*").alias("n_values")).first()  # one number for each language
    total = F.array(*[F.lit((x or 0.0) + UNSEEN * whole["n_values"]) for x in whole["total"]])
    return sums.select(column, F.zip_with("own", total, lambda x, t: F.log((x + UNSEEN) / t)).alias(f"{column}_logs"))


def fused(found: DataFrame, model: TextModel) -> DataFrame:
    """Posteriors of rows of evidence(): id, host, declared, language, confidence, text_language, n_trigrams.

    Rows without trigrams take their language from the other evidence; rows with neither text nor a declared language nor a host are UNKNOWN.
    """
    k = len(model.languages)
    names = F.array(*[F.lit(x) for x in model.languages])
    # Declared languages are at most 26**2 + 26**3 codes and '', suffixes at most SUFFIXES: both tables have a bound and go to every task.
    rows = found.join(priors(found, k), ["host", "domain"])
    rows = rows.join(F.broadcast(likelihood_table(found, "declared", k)), "declared").join(F.broadcast(likelihood_table(found, "suffix", k)), "suffix")
    logs = F.zip_with(F.zip_with("logs", F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b), F.zip_with("declared_logs", "suffix_logs", lambda a, b: a + b), lambda a, b: a + b)
    rows = rows.withColumn("fused", logs).withColumn("most", F.array_max("fused"))
    rows = rows.withColumn("weight", F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most"))))
    silent = (F.col("n_trigrams") == 0) & (F.col("declared") == "") & (F.col("host") == "")
    language = F.get(names, (F.array_position("fused", F.col("most")) - 1).cast("int"))
    text_language = F.get(names, (F.array_position("logs", F.array_max("logs")) - 1).cast("int"))
    return rows.select(
        "id",
        "host",
        "declared",
        F.when(silent, F.lit(UNKNOWN)).otherwise(language).alias("language"),
        F.when(silent, F.lit(0.0)).otherwise(1.0 / F.col("weight")).alias("confidence"),
        F.when(F.col("n_trigrams") > 0, text_language).alias("text_language"),
        "n_trigrams",
    )


def code(column: Column) -> Column:
    """The primary part of a language tag: two or three letters, else ''."""
    return F.regexp_extract(F.lower(F.coalesce(column, F.lit(""))), r"^\s*([a-z]{2,3})(?:[-_].*)?\s*$", 1)


def tag(column: Column) -> Column:
    """A label as a class: its code, else itself in lower case; '' for none."""
    return F.coalesce(F.nullif(code(column), F.lit("")), F.lower(F.trim(column)), F.lit(""))


def page_rows(pages: DataFrame) -> DataFrame:
    """Rows for evidence() from pages (page_id, url, html): the host's last label and the first part of the path where it is a language code; domains are the last two labels; what a page declares is read with its text."""
    url = F.lower(F.coalesce(F.col("url").cast("string"), F.lit("")))
    markup = F.coalesce(F.col("html").cast("string"), F.lit(""))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    path = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2,3})(?:[/?#]|$)", 1)
    suffix = F.concat_ws("|", F.regexp_extract(host, r"([^.]*)$", 1), path)
    return pages.select(F.col("page_id").cast("long").alias("id"), markup.alias("content"), host.alias("host"), F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1).alias("domain"), F.lit("").alias("declared"), F.pmod(F.xxhash64(suffix), F.lit(SUFFIXES)).cast("int").alias("suffix"))


def document_key(docs: DataFrame) -> Column:
    return row_key(docs, "doc_id", "text", "lang", "source")


def document_rows(docs: DataFrame) -> DataFrame:
    """Rows for evidence() from documents: id is document_key(), lang is what is declared, source the host (and its own domain); there is no address."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select(document_key(docs).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"), source.alias("host"), F.lit("").alias("domain"), code(F.col("lang").cast("string")).alias("declared"), F.lit(0).alias("suffix"))


def page_languages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Per page: page_id, host, declared, language, confidence, text_language, n_trigrams. `labelled` (doc_id, text, lang) trains the text model.

    Null or malformed addresses have host '', null html is an empty page, both still get a language from what else is known (an empty page without a declaration, from its host and suffix); unclosed markup of any length is read in one pass; the first html tag alone declares; labels beyond the CLASSES most frequent ones are one class; repeated rows come out as often as they went in, and count as often in the priors; other columns are ignored.
    """
    model = trained(labelled)
    return fused(written(evidence(page_rows(pages), model, markup=True), "page-evidence"), model).withColumnRenamed("id", "page_id")


def in_known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows (with all their columns) whose language is one of those that the documents are labelled with, at a confidence of `least` or more. Each row is judged by its own text, whatever its doc_id; one with neither text nor label is in no language, wherever it is from. An empty table stays empty, rows that repeat are judged alike, and other columns may have any name."""
    model = trained(docs)
    fine = (F.col("language") != UNKNOWN) & (F.col("confidence") >= least) & ((F.col("n_trigrams") > 0) | (F.col("declared") != ""))
    judged = fused(written(evidence(document_rows(docs), model, markup=False), "evidence"), model).select("id", F.coalesce(fine, F.lit(False)).alias("ok"))
    name = unused("rejected", docs)
    # Where different rows share an id by chance, one that is fine keeps the others too.
    rejected = written(judged.groupBy("id").agg(F.bool_or("ok").alias("ok")).where("NOT ok").select(F.col("id").alias(name)), "rejected")
    return docs.join(ids_for_join(rejected), document_key(docs) == F.col(name), "left_anti")
