"""Language of web pages by Bayesian evidence fusion.

The posterior of a language is proportional to
- the text's likelihood: byte n-grams under a naive Bayes model of each language, tempered to at most EFFECTIVE n-grams,
  since neighbouring n-grams aren't independent;
- the likelihood of the declared language (the html element's lang) given the language, from counts over all pages;
- a prior of the page's host, smoothed towards that of its address suffix, and that towards the prior of all pages. The
  counts are sums of the texts' posteriors over all pages, less the page's own.

Plain documents have text and source only; their source stands for the host.

The n-gram model is fitted on the PER_LANGUAGE labelled documents of least hash for each language, a bounded sample; all
other counts cover all pages. Hosts, suffixes and declarations are counted by grouped aggregation with partial sums, so
a host that holds a third of all pages is no single task.

Defined results: a null or empty page has no text evidence and gets its other evidence's language; a null or odd
address has no host or suffix and the prior of all pages; a page without declaration has no such evidence; null ids are
carried; repeated rows are judged one by one; ties fall to the first language by name; without labelled documents the
language is null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planlens.llm.common import ship, text_of, written

#: Labelled documents of a language that the model is fitted on; bytes in an n-gram; cells of the model's table.
PER_LANGUAGE, GRAM, CELLS = 500, 3, 1 << 15
#: Languages whose row counts are broadcast.
MOST_LANGUAGES = 50_000
#: N-grams that a text counts for at most; weight, in pages, of the level above a host or suffix; of an unseen declaration.
EFFECTIVE, STRENGTH, UNSEEN = 60.0, 5.0, 1.0

#: Scripts, styles and comments that aren't closed go on to the end, so that no place is read twice.
_NOT_TEXT = r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[^<>]*+>"


def visible(html: Column) -> Column:
    """A page's text: without scripts, styles, comments, tags and character references."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), _NOT_TEXT, " "), r"&[A-Za-z#0-9]{1,10};", " "))


def declared(html: Column) -> Column:
    """The main language that the html element declares."""
    x = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return F.when(x != "", x)


def host(url: Column) -> Column:
    x = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(x != "", x)


def suffix(host_: Column) -> Column:
    """The last label of a host."""
    return F.when(host_.isNotNull(), F.substring_index(host_, ".", -1))


def _cells(data: np.ndarray) -> np.ndarray:
    """The model's cell of each n-gram of bytes."""
    x = np.zeros(max(len(data) - GRAM + 1, 0), np.uint32)
    for k in range(GRAM):
        x = x * np.uint32(0x9E3779B1) + data[k : k + len(x)].astype(np.uint32) + np.uint32(1)
    return (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - CELLS.bit_length() + 1)


def _spaced(text: str) -> np.ndarray:
    return np.frombuffer(" ".join(text.split()).encode("utf-8", "replace"), np.uint8)


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities of cells by language), from a bounded sample of labelled texts: per_language of least hash for each."""
    ship(labelled.sparkSession)
    d = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    d = d.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    # Hashes are spread evenly, so those below a share of their range hold all that is wanted (4 times as many rows), and
    # no task sees more, however many tasks there are; equal rows count once.
    sizes = written(d.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).withColumnRenamed("lang", "_lang"))
    if sizes.count() <= MOST_LANGUAGES:  # else a join that moves the texts
        sizes = F.broadcast(sizes)
    share = F.lit(4.0 * per_language) / F.col("n")
    few = d.join(sizes, F.col("lang") == F.col("_lang")).where((F.col("h").cast("double") + 2.0**63) / 2.0**64 < share)
    few = few.groupBy("lang", "h").agg(F.first("text").alias("text"))
    n = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    sample = few.withColumn("n", n).where(F.col("n") <= per_language).select("lang", F.lower("text").alias("text"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                sums.setdefault(lang, np.zeros(CELLS))
                sums[lang] += np.bincount(_cells(_spaced(text)), minlength=CELLS)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "counts": [s.tobytes() for s in sums.values()]})

    total: dict[str, np.ndarray] = {}
    for r in sample.repartition(4).mapInPandas(count, "lang string, counts binary").collect():  # 4 rows a language
        total[r.lang] = total.get(r.lang, np.zeros(CELLS)) + np.frombuffer(r.counts)
    languages = sorted(total)
    table = np.stack([np.log((total[x] + 0.5) / (total[x].sum() + 0.5 * CELLS)) for x in languages]) if languages else np.zeros((0, CELLS))
    return languages, table.astype(np.float32)


def text_evidence(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Tempered log-likelihoods, a row for each text."""
    out = np.zeros((len(texts), len(table)))
    for i, t in enumerate(texts):
        c = _cells(_spaced(t))
        if len(c):
            out[i] = table[:, c].sum(axis=1, dtype=np.float64) * min(1.0, EFFECTIVE / len(c))
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sums(d: DataFrame, by: str, languages: list[str], name: str) -> DataFrame:
    """Soft counts of languages for each value of a column, and for all (value null)."""
    return d.where(F.col(by).isNotNull()).groupBy(F.col(by).alias(f"_{by}")).agg(F.array(*[F.sum(F.col("soft")[i]) for i in range(len(languages))]).alias(name))


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """id, lang, posterior, text_lang, declared and host_prior (of lang) of every page. Pages' texts are never shuffled."""
    h = host(F.col(url_col))
    d = pages.select(F.col(id_col).alias("id"), declared(F.col(html_col)).alias("declared"), h.alias("host"), suffix(h).alias("suffix"), visible(F.col(html_col)).alias("text"))
    return _fused(d, model, id_col)


def identify_texts(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The same for plain texts: without markup and address, their source takes the host's place."""
    none = F.lit(None).cast("string")
    return _fused(docs.select(F.col(id_col).alias("id"), none.alias("declared"), F.col(source_col).alias("host"), none.alias("suffix"), F.lower(text_of(text_col)).alias("text")), model, id_col)


def _fused(d: DataFrame, model: tuple[list[str], np.ndarray], id_col: str) -> DataFrame:
    """From id, declared, host, suffix and text."""
    languages, table = model
    ship(d.sparkSession)
    if not languages:
        no = F.lit(None)
        return d.select(F.col("id").alias(id_col), no.cast("string").alias("lang"), no.cast("double").alias("posterior"), no.cast("string").alias("text_lang"), "declared", no.cast("double").alias("host_prior"))

    def score(batches):
        for b in batches:
            logs = text_evidence(list(b["text"]), table)
            yield b[["id", "declared", "host", "suffix"]].assign(logs=list(logs), soft=list(_softmax(logs)) if len(logs) else [])

    id_type = d.schema["id"].dataType.simpleString()
    d = written(d.mapInPandas(score, f"id {id_type}, declared string, host string, suffix string, logs array<double>, soft array<double>"))
    k = len(languages)
    numbers = F.sequence(F.lit(0), F.lit(k - 1))
    at = lambda a, i: F.get(a, i)
    everything = d.agg(F.array(*[F.coalesce(F.sum(F.col("soft")[i]), F.lit(0.0)) for i in range(k)]).alias("all"))  # one row
    said = _sums(d, "declared", languages, "said")
    of_suffix, of_host = _sums(d, "suffix", languages, "in_suffix"), _sums(d, "host", languages, "in_host")
    n_said = said.agg(F.count("*").alias("kinds"))
    j = d.join(F.broadcast(everything)).join(F.broadcast(n_said))
    for t, c in ((said, "declared"), (of_suffix, "suffix"), (of_host, "host")):
        j = j.join(t, F.col(c) == F.col(f"_{c}"), "left")
    own = lambda a: F.when(F.col(a).isNull(), F.array_repeat(F.lit(0.0), k)).otherwise(F.transform(numbers, lambda i: F.greatest(at(F.col(a), i) - at(F.col("soft"), i), F.lit(0.0))))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    smooth = lambda counts, above: F.transform(numbers, lambda i: (at(counts, i) + STRENGTH * at(above, i)) / (total(counts) + STRENGTH))
    j = j.select("*", own("all").alias("n0"), own("in_suffix").alias("n1"), own("in_host").alias("n2"))
    j = j.select("*", F.transform(numbers, lambda i: (at(F.col("n0"), i) + 1.0) / (total(F.col("n0")) + float(k))).alias("p0"))
    j = j.select("*", smooth(F.col("n1"), F.col("p0")).alias("p1"))
    j = j.select("*", smooth(F.col("n2"), F.col("p1")).alias("p2"))
    # The share of a language's pages that make this declaration.
    declares = F.when(F.col("said").isNull(), F.array_repeat(F.lit(1.0), k)).otherwise(F.transform(
        numbers, lambda i: (F.greatest(at(F.col("said"), i) - at(F.col("soft"), i), F.lit(0.0)) + UNSEEN) / (at(F.col("all"), i) + UNSEEN * (F.col("kinds") + 1))))
    j = j.select("*", declares.alias("declares"))
    j = j.select("*", F.transform(numbers, lambda i: at(F.col("logs"), i) + F.log(at(F.col("declares"), i)) + F.log(at(F.col("p2"), i))).alias("fused"))
    j = j.select("*", F.transform("fused", lambda x: F.exp(x - F.array_max("fused"))).alias("weights"))
    names = F.array(*map(F.lit, languages))
    first = lambda a: F.array_position(a, F.array_max(a)).cast("int") - 1
    j = j.select("*", first("weights").alias("best"), first("logs").alias("best_text"))
    return j.select(F.col("id").alias(id_col), at(names, F.col("best")).alias("lang"), F.round(at(F.col("weights"), F.col("best")) / total(F.col("weights")), 6).alias("posterior"),
                    F.when(F.array_min("logs") < F.array_max("logs"), at(names, F.col("best_text"))).alias("text_lang"), "declared", F.round(at(F.col("p2"), F.col("best")), 6).alias("host_prior"))


def op10(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Every page (page_id) and, with the evidence they have, every document (doc_id)."""
    model = fit(docs)
    return identify(pages, model).unionByName(identify_texts(docs, model), allowMissingColumns=True)
