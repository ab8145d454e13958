"""Language ID by Bayesian evidence fusion.

Four witnesses speak for each row, in logarithms: the text (byte trigrams under
naive Bayes), the language that the markup declares, the suffix of the
address, and what is known of the host. The text's tables are fitted on at most
TRAIN_ROWS labelled rows. How far markup and address suffix can be trusted is
measured over all rows, by how they go with what the text says. Host priors are
smoothed in steps: a host leans on its domain, a domain on all rows; they are sums of text posteriors by grouped aggregation, combined
before their shuffle, and each row is taken out of its own prior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import fold_of, stash, text_bytes

#: Bound of the fit; trigram buckets; trigrams that count as independent; pseudo-rows that a level lends to the one below.
TRAIN_ROWS, BUCKETS, TRUST, LEAN = 20_000, 1 << 16, 100.0, 5.0
_TAG = re.compile(rb"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[^>]*(?:>|\Z)|&#?\w+;?", re.S | re.I)
_LANG = re.compile(rb"""<html\b[^>]*?\s(?:xml:)?lang\s*=\s*["']?([a-zA-Z]{2,3})|<meta\b[^>]*?content-language["'][^>]*?content\s*=\s*["']([a-zA-Z]{2,3})""", re.I)
#: What may declare a language, and what hides such marks: comments, scripts and styles.
_HEAD = re.compile(rb"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(?:html|meta)\b[^>]*", re.S | re.I)
_CHUNK = 4 << 20


def codes(text: bytes) -> np.ndarray:
    """Hashed byte trigrams; text is lower-cased (A-Z), and what is no letter counts as one space."""
    b = np.frombuffer(b" " + re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", text.lower()) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    x = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)
    return x >> np.uint32(16)


def declared_language(html: bytes) -> str | None:
    """The language of the first html or meta element that declares one, wherever it stands."""
    for part in _HEAD.finditer(html):
        m = _LANG.match(part[0])
        if m:
            return (m[1] or m[2]).decode().lower()
    return None


def _trained(batches: Iterator[pa.RecordBatch], langs: list[str]) -> Iterator[pa.RecordBatch]:
    sums, number = np.zeros((len(langs), BUCKETS), np.int64), {name: i for i, name in enumerate(langs)}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            sums[number[lang]] += np.bincount(codes(text.as_py()), minlength=BUCKETS)
    lang, code = np.nonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(sums[lang, code])], ["lang", "code", "n"])


def train_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS, folds: int = 5) -> tuple[list[str], np.ndarray]:
    """Languages and their log-likelihood tables, from labelled rows whose crc32(id) modulo folds is not 0."""
    known = docs.where(F.col(lang).isNotNull() & (F.col(lang) != "")).where(fold_of(doc_id, folds) != 0)
    ids = stash(known.select(F.col(doc_id).alias("doc")).where("doc is not null").orderBy(F.xxhash64("doc"), "doc").limit(rows), "lang-rows")
    own = known.select(F.col(doc_id).alias("doc"), F.col(lang).alias("lang"), text_bytes(text).alias("t")).join(F.broadcast(ids.distinct()), "doc")
    own = stash(own.select("lang", "t"), "lang-texts")  # rows labelled rows at most
    langs = sorted(r[0] for r in own.select("lang").distinct().collect())
    sums = np.zeros((len(langs), BUCKETS))
    counted = own.mapInArrow(partial(_trained, langs=langs), "lang int, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # languages x BUCKETS at most
        sums[r.lang, r.code] = r.n
    return langs, np.log((sums + 0.5) / (sums.sum(1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)


def _witness(batches: Iterator[pa.RecordBatch], langs: list[str], table: np.ndarray, markup: bool) -> Iterator[pa.RecordBatch]:
    """(id, declared language, log-likelihoods of the text)."""
    flat = np.ascontiguousarray(table.T)
    for batch in batches:
        declared, found = [], []
        for raw in batch.column(1):
            text = raw.as_py()
            declared.append(declared_language(text) if markup else None)
            if markup:
                text = _TAG.sub(b" ", text)
            c = codes(text)
            total = np.zeros(len(langs))
            for at in range(0, len(c), _CHUNK):
                total += flat[c[at : at + _CHUNK]].sum(0, dtype=np.float64)
            # trigrams overlap and repeat: beyond TRUST of them, evidence grows with the root of their number
            found.append((total * min(1.0, (TRUST / max(1, len(c))) ** 0.5)).tolist())
        ll = pa.array(found, pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(declared, pa.string()), ll], ["id", "declared", "ll"])


def softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    up = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(up, lambda x: x / F.aggregate(up, F.lit(0.0), lambda a, b: a + b))


def _sums(df: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array(*[F.sum(F.col("post")[i]) for i in range(n)]).alias(name))


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _log(a: Column) -> Column:
    return F.transform(a, lambda x: F.log(x))


def identify(rows: DataFrame, langs: list[str], table: np.ndarray, row_id: str = "id", content: str = "content", url: str = "url", host: str | None = None, markup: bool = True) -> DataFrame:
    """id, lang, confidence, text_lang and declared for every row.

    host: a column to use in place of the address's host. markup: whether
    content is HTML. Null or empty content, address or host: that witness is
    silent. Nothing at all known: the most frequent language overall. A null id
    is returned as null; repeated rows are answered one by one, each still
    counting for its host. Without any language the answer is null. Empty
    table: empty result. Other columns are ignored.
    """
    n = len(langs)
    kind = rows.schema[row_id].dataType.simpleString()
    at = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    name = F.lower(F.coalesce(F.col(host).cast("string"), F.lit(""))) if host else at
    read = rows.select(F.struct(F.col(row_id).alias("id"), name.alias("host")).alias("id"), text_bytes(content).alias("t"))
    if not n:
        return read.select(F.col("id.id").alias(row_id), *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("confidence", "double"), ("text_lang", "string"), ("declared", "string"))])
    made = read.mapInArrow(partial(_witness, langs=langs, table=table, markup=markup), f"id struct<id:{kind},host:string>, declared string, ll array<double>")
    made = made.select("id.id", "id.host", F.coalesce("declared", F.lit("")).alias("declared"), "ll", softmax(F.col("ll")).alias("post"))
    made = made.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).withColumn("suffix", F.regexp_extract("host", r"\.([^.]+)$", 1))
    made = stash(made, "lang-witness")
    sums = made.agg(*[F.sum(F.col("post")[i]) for i in range(n)]).first()  # one number a language
    every = [(x or 0.0) + 1.0 for x in sums]
    total = F.array(*[F.lit(x) for x in every])
    # how often each language's rows have a value: P(value | language)
    said = lambda c, known: F.when(known, _log(F.zip_with(c, total, lambda x, t: (x + 0.05) / (t + 1.0)))).otherwise(F.array(*[F.lit(0.0)] * n))
    declared = _sums(made, ["declared"], n, "s").select("declared", said("s", F.col("declared") != "").alias("l_declared"))
    hosts = stash(_sums(made, ["host", "domain", "suffix"], n, "s_host"), "lang-hosts")
    upward = lambda df, keys, low, high: df.groupBy(*keys).agg(F.array(*[F.sum(F.col(low)[i]) for i in range(n)]).alias(high))
    domains = upward(hosts, ["domain", "suffix"], "s_host", "s_domain")
    suffixes = upward(hosts, ["suffix"], "s_host", "s_suffix")
    hosts = hosts.join(domains, ["domain", "suffix"]).join(suffixes, "suffix").select("host", "s_host", "s_domain", said("s_suffix", F.col("suffix") != "").alias("l_suffix"))
    # declared values are two or three letters: 18,278 at most
    whole = made.join(hosts, "host").join(F.broadcast(declared), "declared")

    def lean(prior: Column, sums: str) -> Column:
        own = F.zip_with(sums, "post", lambda s, p: F.greatest(s - p, F.lit(0.0)))
        weight = F.aggregate(own, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(own, prior, lambda s, p: (s + LEAN * p) / (weight + LEAN))

    overall = F.array(*[F.lit(x / sum(every)) for x in every])
    prior = F.when(F.col("host") != "", lean(lean(overall, "s_domain"), "s_host")).otherwise(overall)
    whole = whole.withColumn("prior", prior).withColumn("final", softmax(_add(_add(F.col("ll"), F.col("l_declared")), _add(F.col("l_suffix"), _log(F.col("prior"))))))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return whole.select(F.col("id").alias(row_id), best("final").alias("lang"), F.array_max("final").alias("confidence"), best("post").alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared"))
