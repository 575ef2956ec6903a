"""Language ID (9): Bayesian evidence fusion over web pages.

The posterior of a page's language is the product of
- the likelihood of its visible text, a multinomial over hashed runs of three bytes for each language, tempered because
  neighbouring runs depend on one another;
- the likelihood of the language that its markup declares, and of its address suffix;
- a prior from its host, smoothed towards the other hosts of its domain, and that towards all pages.
The tables behind the last three are grouped sums of the text-only posteriors of all pages; a page's own part is taken
out of its host's counts, and the host's out of its domain's, so that no page counts twice and none for itself. Pages
without an address have no host and no domain, and their prior is that of all pages.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import byte_texts, cut

BUCKETS = 1 << 13
RUN = 3
#: Share of the text's log likelihood that counts, and the most that it may favour one language over another by.
TEMPER = 0.1
MOST_NATS = 30.0
#: Pages that a prior counts for, at each level of the hierarchy.
HOST_WEIGHT = 4.0
DOMAIN_WEIGHT = 16.0
GLOBAL_WEIGHT = 1.0

_HIDDEN = re.compile(rb"(?is)<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>")
_TAG = re.compile(rb"(?s)<[^>]*>")
_DECLARED = re.compile(rb"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b")
_META = re.compile(rb"(?is)<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?\s*([a-z]{2,3})\b")


def visible_text(html: bytes) -> bytes:
    """Text outside tags, scripts, styles and comments, with references resolved, lowered, blanks made single."""
    text = _TAG.sub(b" ", _HIDDEN.sub(b" ", html))
    if b"&" in text:
        text = unescape(text.decode("utf-8", "replace")).encode()
    return b" ".join(text.decode("utf-8", "replace").lower().encode().split())


def declared_language(html: bytes) -> str | None:
    m = _DECLARED.search(html) or _META.search(html)
    return m.group(1).decode().lower() if m else None


# Second-level labels under which a country's registry gives out names.
REGISTRY_LABELS = ("ac", "co", "com", "edu", "gov", "ne", "net", "or", "org")


def host_parts(url: str | None) -> tuple[str, str, str]:
    """Host, registered domain and suffix (the last label); empty where there is none.

    A registered domain has two labels, or three under a registry's label before a country's two letters (example.co.uk).
    """
    m = re.match(r"(?i)\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    host = m.group(1).lower().strip(".") if m else ""
    labels = host.split(".")
    size = 3 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in REGISTRY_LABELS else 2
    return host, ".".join(labels[-size:]), labels[-1]


def run_buckets(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < RUN:
        return np.empty(0, np.int64)
    h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)


def language_counts(docs: DataFrame, buckets: int = BUCKETS) -> dict[str, np.ndarray]:
    """Counts of the runs in each language of all documents (text, lang), summed in each partition and then by language."""

    def partial(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(byte_texts(batch), batch.column("lang").to_pylist(), strict=True):
                plain = b" ".join(text.decode("utf-8", "replace").lower().encode().split())
                counts = np.bincount(run_buckets(plain, buckets), minlength=buckets)
                total[lang] = total[lang] + counts if lang in total else counts
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.astype(np.int64).tobytes() for v in total.values()], pa.binary())], names=["lang", "part"])

    def added(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in zip(batch.column("lang").to_pylist(), batch.column("part").to_pylist(), strict=True):
                total[lang] = total.get(lang, 0) + np.frombuffer(part, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["lang", "part"])

    known = docs.where("lang is not null").select(F.col("text").cast("string"), F.lower("lang").alias("lang"))
    rows = known.mapInArrow(partial, "lang string, part binary").repartition(8).mapInArrow(added, "lang string, part binary").collect()
    total: dict[str, np.ndarray] = {}
    for r in rows:
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["part"], np.int64)
    return dict(sorted(total.items()))


def log_shares(counts: dict[str, np.ndarray]) -> np.ndarray:
    """languages x buckets: ln of each bucket's share, with one added to each count."""
    table = np.array(list(counts.values()), np.float64) + 1
    return np.log(table / table.sum(axis=1, keepdims=True))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def text_evidence(pages: DataFrame, shares: np.ndarray, buckets: int = BUCKETS) -> DataFrame:
    """page_id, host, domain, suffix, declared, ll: tempered log likelihoods of the whole visible text, 0 at best."""
    kernel = shares.T.copy()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ll, parts, declared = [], [], []
            for html, url in zip(byte_texts(batch, "html"), batch.column("url").to_pylist(), strict=True):
                counts = np.bincount(run_buckets(visible_text(html), buckets), minlength=buckets)
                x = TEMPER * (counts @ kernel)
                ll.append(np.maximum(x - x.max(), -MOST_NATS).tolist())
                parts.append(host_parts(url))
                declared.append(declared_language(html) or "")
            columns = list(zip(*parts, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *(pa.array(c, pa.string()) for c in columns), pa.array(declared, pa.string()), pa.array(ll, pa.list_(pa.float64()))],
                names=["page_id", "host", "domain", "suffix", "declared", "ll"],
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, host string, domain string, suffix string, declared string, ll array<double>")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """The language of each page (page_id, url, html), with models of the languages of docs (text, lang).

    Returns page_id, lang, probability, text_lang (of the text alone), declared, host. A null or empty page has no text
    evidence and takes its language from the rest; equal probabilities go to the first language in alphabetical order. A
    null address is of no host. Without documents that name a language lang is null and probability 0. Rows that
    repeat a page_id are judged each by itself. Other columns are ignored.
    """
    counts = language_counts(docs)
    langs = list(counts)
    if not langs:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), *[F.lit(None).cast("string").alias(c) for c in ("lang", "text_lang", "declared", "host")], F.lit(0.0).alias("probability"))
    n = len(langs)
    seen = cut(text_evidence(pages, log_shares(counts)))
    # Text-only posteriors; each page adds its own to its host, domain, suffix and declared language.
    weights = F.transform("ll", lambda x: F.exp(x))
    soft = seen.withColumn("_w", weights).withColumn("_s", F.aggregate("_w", F.lit(0.0), lambda a, x: a + x)).withColumn("post", F.transform("_w", lambda x: x / F.col("_s"))).drop("_w", "_s")

    def sums(key: str) -> DataFrame:
        return soft.groupBy(F.col(key).alias(f"_{key}")).agg(F.array(*[F.sum(F.col("post")[i]) for i in range(n)]).alias(f"by_{key}"))

    everything = soft.agg(F.array(*[F.coalesce(F.sum(F.col("post")[i]), F.lit(0.0)) for i in range(n)]).alias("all")).first()["all"]
    joined = soft
    for key in ("host", "domain", "suffix", "declared"):
        joined = joined.join(sums(key), F.col(key) == F.col(f"_{key}")).drop(f"_{key}")

    def fuse(batches):
        import pyarrow as pa

        total = np.array(everything)
        for batch in batches:
            if not len(batch):
                continue
            ll, post, host, domain, suffix, said = (np.array(batch.column(c).to_pylist(), np.float64) for c in ("ll", "post", "by_host", "by_domain", "by_suffix", "by_declared"))
            # What is left without the page itself, never below 0.
            rest = lambda x: np.maximum(x - post, 0)
            world = (rest(total) + GLOBAL_WEIGHT) / (rest(total).sum(axis=1, keepdims=True) + GLOBAL_WEIGHT * n)
            named = np.array([bool(x) for x in batch.column("host").to_pylist()])[:, None]
            others, own = np.maximum(domain - host, 0) * named, rest(host) * named
            by_domain = (others + DOMAIN_WEIGHT * world) / (others.sum(axis=1, keepdims=True) + DOMAIN_WEIGHT)
            prior = (own + HOST_WEIGHT * by_domain) / (own.sum(axis=1, keepdims=True) + HOST_WEIGHT)
            # P(suffix | language) and P(declared | language), by which share of the language's pages have it.
            likely = [np.log((rest(x) + world) / (rest(total) + 1)) for x in (suffix, said)]
            p = softmax(ll + np.log(prior) + likely[0] + likely[1])
            best, by_text = p.argmax(axis=1), ll.argmax(axis=1)
            names = np.array(langs, object)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array(names[best]), pa.array(p[np.arange(len(p)), best]), pa.array(names[by_text]), batch.column("declared"), batch.column("host")],
                names=["page_id", "lang", "probability", "text_lang", "declared", "host"],
            )

    return joined.mapInArrow(fuse, "page_id long, lang string, probability double, text_lang string, declared string, host string")
