"""Language identification by Bayesian evidence fusion.

Every row is a text with optional evidence: a declared language (markup), an
address mark (host suffix and language path segment) and a host. Four factors
give the posterior over the languages:

    P(l | row)  ~  P(text | l)^(1/TEMPER) * P(declared | l) * P(address | l) * P(l | host)

* text: character-trigram model with hashed counts, fitted on a bounded sample
  of labelled rows (``SAMPLE`` per language, the least by hash, and the
  ``LANGUAGES`` labels with the most rows, so that dirty labels cannot grow it);
* declared and address: how often each value comes with texts of language l,
  by a grouped sum of text posteriors over all rows, Laplace-smoothed;
* host: Dirichlet-smoothed counts, host towards address, address towards the
  whole corpus, again by grouped sums; a row's own share is taken out first.

A posterior is one array. The sums are taken over (value, language) rows of the
non-zero posteriors, combined map-side, so a host with a third of all rows costs
nothing extra; the tables of values are joined on equality and split when
skewed, and one kernel fuses the arrays of a row, however many languages there
are.

A row is rejected (language "und") when its text holds no letters, or when its
letter trigrams fit no language: the best log-likelihood is below what evenly
drawn trigrams get, by more than ``DOUBT``, so that a few odd trigrams do not
condemn a short text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelspark.llm.common import KEY, binary_values, broadcast_if, prepare, release, released, row_key

#: Labelled rows per language the text model is fitted on.
SAMPLE = 2000
#: Labels the text model tells apart: those with the most rows. Others stay evidence.
LANGUAGES = 512
BUCKETS = 1 << 15
#: Trigrams scored together.
BLOCK = 1 << 12
#: Neighbouring trigrams are not independent: log-likelihoods count 1/TEMPER.
TEMPER = 3.0
#: Nats by which evenly drawn trigrams must be likelier for a text to be rejected.
DOUBT = 40.0
#: Strength of the Dirichlet priors, in rows.
HOST_PRIOR, ADDRESS_PRIOR = 10.0, 100.0

_MARKUP = re.compile(rb"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
_FOLD = np.array([32 if c < 128 and not chr(c).isalpha() else c for c in range(128)], np.uint32)


def trigram_buckets(text: bytes) -> np.ndarray:
    """Hashed trigrams of a text's lower-cased letters; other ASCII counts as space."""
    codes = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
    ascii_ = codes < 128
    codes = np.where(ascii_, _FOLD[np.where(ascii_, codes, 0)], codes)
    space = codes == 32
    codes = codes[~(space & np.concatenate(([False], space[:-1])))] if len(codes) else codes
    if len(codes) < 3:
        return np.empty(0, np.int64)
    h = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    return ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts per language within a task."""
    total: dict[str, np.ndarray] = {}
    for batch in released(batches):
        for lang, text in zip(batch.column("label").to_pylist(), binary_values(batch.column("text")), strict=True):
            total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            total[lang] += np.bincount(trigram_buckets(text), minlength=BUCKETS)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])],
                                         names=["label", "bucket", "n"])


def _dense(key: tuple, table: pa.Table) -> pa.Table:
    """log P(bucket | label), half a count in every bucket."""
    model = np.full(BUCKETS, 0.5)
    model[table.column("bucket").to_numpy()] += table.column("n").to_numpy()
    return pa.table({"label": pa.array([key[0].as_py()]), "logs": pa.array([np.log(model / model.sum()).astype(np.float32).tobytes()], pa.binary())})


def fit_text_model(labelled: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """(languages, log P(bucket | language)) from (text, label) rows; at most
    ``sample`` rows of each of the ``languages`` most frequent labels (ties by
    name) are read, the least by hash of the text. The model is what reaches
    the driver: 128 KB for each language."""
    known = labelled.where("label is not null and text is not null")
    common = (known.groupBy("label").agg(F.count(F.lit(1)).alias("__reel_n")).orderBy(F.col("__reel_n").desc(), "label").limit(languages).select("label"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("__reel_h"))
    chosen = (known.withColumn("__reel_h", row_key(F.col("text"))).select("label", "__reel_h").distinct()
              .join(F.broadcast(common), "label").withColumn("r", rank).where(F.col("r") <= sample).select("label", "__reel_h").checkpoint())
    rows = (labelled.withColumn("__reel_h", row_key(F.col("text"))).join(broadcast_if(chosen, chosen.count()), ["label", "__reel_h"])
            .groupBy("label", "__reel_h").agg(F.first("text").alias("text")).select("label", "text"))
    counts = rows.mapInArrow(_count, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    models = sorted(counts.groupBy("label").applyInArrow(_dense, "label string, logs binary").collect(), key=lambda r: r["label"])
    if not models:
        return [], np.zeros((BUCKETS, 0), np.float32)
    return [r["label"] for r in models], np.stack([np.frombuffer(r["logs"], np.float32) for r in models], axis=1)


def _score(model: np.ndarray, markup: bool):
    """Per row: letter trigrams, and the summed log-likelihood per language."""
    def run(texts: pa.Array) -> pa.Array:
        n, sums = [], []
        for text in binary_values(texts):
            buckets = trigram_buckets(_MARKUP.sub(b" ", text) if markup else text)
            n.append(len(buckets))
            total = np.zeros(model.shape[1])
            for lo in range(0, len(buckets), BLOCK):
                total += np.add.reduce(model[buckets[lo:lo + BLOCK]], axis=0, dtype=np.float64)
            sums.append(total)
        release()
        flat = pa.array(np.concatenate(sums) if sums else np.empty(0))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * model.shape[1]), flat)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), lists], names=["n", "ll"])
    return F.arrow_udf(run, "struct<n:bigint,ll:array<double>>")


def text_evidence(rows: DataFrame, model: np.ndarray, markup: bool = False) -> DataFrame:
    """Adds n (letter trigrams) and ll (log-likelihood per language) for ``text``, and drops it."""
    return rows.withColumn("__reel_s", _score(model, markup)(F.col("text"))).select(*[c for c in rows.columns if c != "text"], "__reel_s.*")


def _posterior(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _arrays(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, width) with zeros where the array is null; which rows have one."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    if there.any():
        out[there] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out, there


def _fused(languages: list[str], total: np.ndarray, keep: list[str]):
    """Rows with ll, n and the sums by declared language, address and host -> the decision."""
    width = len(languages)
    base = (total + 1.0) / (total.sum() + width)
    names = np.array([*languages, "und"], dtype=object)

    def likelihood(column: pa.Array) -> np.ndarray:
        """log P(value | language), smoothed with one row per language; 0 where there is no value."""
        sums, there = _arrays(column, width)
        return np.where(there[:, None], np.log((sums + base) / (total + 1.0)), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            ll, _ = _arrays(batch.column("ll"), width)
            has = (n > 0)[:, None]
            own = np.where(has, _posterior(ll / TEMPER), 0.0)
            # counts under the row's address and host, without the row itself
            at_address, at_host = (np.maximum(_arrays(batch.column(c), width)[0] - own, 0.0) for c in ("s_address", "s_host"))
            near = (at_address + ADDRESS_PRIOR * base) / (at_address.sum(axis=1, keepdims=True) + ADDRESS_PRIOR)
            prior = (at_host + HOST_PRIOR * near) / (at_host.sum(axis=1, keepdims=True) + HOST_PRIOR)
            post = _posterior(np.log(prior) + np.where(has, ll / TEMPER, 0.0) + likelihood(batch.column("s_declared")) + likelihood(batch.column("s_address")))
            accepted = (n > 0) & (ll.max(axis=1) >= -float(np.log(BUCKETS)) * n - DOUBT)
            best = np.where(accepted, post.argmax(axis=1), width)
            by_text = np.where(n > 0, ll.argmax(axis=1), width)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(names[best], pa.string()), pa.array(np.where(accepted, post.max(axis=1), 0.0)),
                 pa.array(names[by_text], pa.string()), pa.array(accepted)], names=[*keep, "lang", "p", "text_lang", "accepted"])
    return run


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """Rows with (n, ll, declared, address, host) -> the same rows with
    lang, p (posterior of lang), text_lang and accepted instead of n and ll."""
    keep = [c for c in rows.columns if c not in ("n", "ll")]
    evidence = ("declared", "address", "host")
    p = rows.checkpoint()
    exps = F.transform("ll", lambda x: F.exp((x - F.array_max("ll")) / TEMPER))
    values = F.array(F.struct(F.lit("total").alias("kind"), F.lit("").alias("value")), *[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in evidence])
    shares = (p.where("n > 0").withColumn("__reel_e", exps).withColumn("__reel_t", F.aggregate("__reel_e", F.lit(0.0), lambda a, x: a + x))
              .select(F.filter(values, lambda v: v["value"].isNotNull()).alias("values"), "__reel_t", F.posexplode("__reel_e").alias("i", "e"))
              .where("e > 0").select(F.inline("values"), "i", (F.col("e") / F.col("__reel_t")).alias("s")))
    sums = shares.groupBy("kind", "value", "i").agg(F.sum("s").alias("s"))
    whole = F.map_from_entries(F.collect_list(F.struct("i", "s")))  # one entry a language
    filled = F.transform(F.sequence(F.lit(0), F.lit(len(languages) - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    sums = sums.groupBy("kind", "value").agg(whole.alias("m")).select("kind", "value", filled.alias("sums")).checkpoint()
    total = sums.where("kind = 'total'").first()
    for c in evidence:
        t = sums.where(F.col("kind") == c).select(F.col("value").alias(f"__reel_{c}"), F.col("sums").alias(f"s_{c}"))
        p = p.join(broadcast_if(t, t.count() * len(languages)), p[c] == t[f"__reel_{c}"], "left")
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang string, p double, text_lang string, accepted boolean"
    return p.select(*keep, "n", "ll", *[f"s_{c}" for c in evidence]).mapInArrow(
        _fused(languages, np.array(total["sums"]) if total else np.zeros(len(languages)), keep), schema)


def _document_rows(docs: DataFrame) -> DataFrame:
    text = lambda c: (F.col(c) if c in docs.columns else F.lit(None)).cast("string")
    return docs.select(F.lit("documents").alias("kind"), F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("page_id"),
                       row_key(F.col("text")).alias(KEY), "text", text("lang").alias("declared"),
                       F.lit(None).cast("string").alias("address"), text("source").alias("host"))


def _page_rows(pages: DataFrame) -> DataFrame:
    """Host in lower case; address: its last label and, if there, a two-letter first path segment."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    mark = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]+://[^/]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    lang = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return pages.select(F.lit("pages").alias("kind"), F.lit(None).cast("bigint").alias("doc_id"), F.col("page_id").cast("bigint").alias("page_id"),
                        row_key(F.col("html")).alias(KEY), F.col("html").alias("text"), F.nullif(lang, F.lit("")).alias("declared"),
                        F.when(host != "", F.concat_ws("/", F.substring_index(host, ".", -1), F.nullif(mark, F.lit("")))).alias("address"),
                        F.nullif(host, F.lit("")).alias("host"))


def identify(docs: DataFrame, pages: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """kind (documents or pages), doc_id, page_id, declared, host, lang, p,
    text_lang, accepted per row of ``docs`` and ``pages``.

    A document's declared language is its ``lang``, its host its ``source``;
    the languages are the labels in ``lang``. Missing or null evidence says
    nothing. Null, empty and letterless texts are "und" with p = 0 and not
    accepted; so is every row when no document has both a text and a lang.
    Equally likely languages: the first by name. Very long texts are scored
    whole, a block of trigrams at a time. Repeated rows each get a row; other columns are ignored; empty tables give
    empty results.
    """
    prepare(docs.sparkSession)
    rows = _document_rows(docs)
    languages, model = fit_text_model(rows.select("text", F.col("declared").alias("label")), sample)
    if not languages:
        languages, model = ["und"], np.full((BUCKETS, 1), -1e6, np.float32)
    scored = text_evidence(rows, model)
    if pages is not None:
        scored = scored.unionByName(text_evidence(_page_rows(pages), model, markup=True))
    return fuse(scored, languages)


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows of ``docs`` whose language is identified; the others go."""
    found = identify(docs, sample=sample)
    bad = found.where("not accepted").select(F.col("doc_id").alias("__reel_id"), F.col(KEY).alias("__reel_k")).distinct()
    d = docs.withColumn(KEY, row_key(F.col("text")))
    return (d.join(bad, d["doc_id"].cast("bigint").eqNullSafe(bad["__reel_id"]) & (d[KEY] == bad["__reel_k"]), "left_anti")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
