"""Language identification of web pages by fusing evidence in Bayes' manner.

Four kinds of evidence about a page are put together as log probabilities of the languages:

* its visible text, under hashed character-trigram models trained on labelled documents (a bounded
  sample, `max_docs`, chosen by a hash of the id, an equal share of each language); all languages are
  learned, and more than `max_languages` are an error;
* the language its markup declares (the lang attribute of the first html tag that has one, wherever
  it stands outside comments and scripts);
* the suffix of its address (a language code that opens the path, else the last label of the host);
* its host, as a prior: counts of the host's pages by language, smoothed towards those of its
  domain (the last two labels), and these towards all pages.

How far declarations and suffixes can be trusted, and the priors, come from grouped counts over all
pages by the language their text alone suggests; a page's own count is left out of its prior. Only
small rows are grouped and joined, never markup; a hot host is folded before the shuffle, and its
pages' rows join a single row of counts, which adaptive execution splits.

Edge cases: null or empty markup gives no text evidence and no declaration; a null address gives no
suffix and a host of its own, ""; repeated rows are judged each. Without labelled documents the
result has null languages; an empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

BUCKETS = 1 << 16

#: Strength of the wider level in a prior, counts added to a rate, and trigrams that count as one observation.
PRIOR, ADDED, TEMPER = 4.0, 0.5, 4.0

_HIDDEN = re.compile(r"<(?:(!--)|(script|style|template|noscript)\b)", re.I)
_NAV = re.compile(r"<(?:(div)|(nav|header|footer|aside))\b", re.I)
_AD = re.compile(r"\bclass=[\"']ad[\"']", re.I)
_END = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "template", "noscript", "nav", "header", "footer", "aside", "div")} | {"!--": re.compile("-->")}
_HTML = re.compile(r"<html\b([^>]*)", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)
_ADDRESS = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?(?:/([^/?#]*))?([^?#]*)", re.I)
_NUMBER = re.compile(r"(\d{1,18})(?:\.\w+)?/?$")


def _without(page: str, opening: re.Pattern) -> str:
    """page with a space for each element that `opening` finds, up to the end of it; one without an end stays.

    Linear: an end that isn't there is looked for once, and places already looked at are skipped.
    """
    out, done, at, plain, open_ended = [], 0, 0, 0, set()
    while found := opening.search(page, at):
        kind, at = (found[1] or found[2]).lower(), found.end()
        if kind in open_ended or kind == "div" and at <= plain:
            continue
        if kind == "div":  # an advertisement, if its class says so
            close = page.find(">", at)
            if close >= 0 and not _AD.search(page, at, close):
                plain = close
                continue
            end = _END[kind].search(page, close) if close >= 0 else None
        else:
            end = _END[kind].search(page, at)
        if end is None:
            open_ended.add(kind)
            continue
        out.append(page[done : found.start()])
        done = at = end.end()
    return " ".join([*out, page[done:]])


def shown(page: str) -> str:
    """Markup of a page without scripts, styles and comments."""
    return _without(page, _HIDDEN)


def visible(page: str) -> str:
    """Text of shown markup without navigation and advertisements; a tag goes from < to the next >."""
    *closed, rest = _without(page, _NAV).split(">")
    return markup.unescape("".join([x[: x.index("<")] + " " if "<" in x else x + ">" for x in closed] + [rest]))


def declared(page: str) -> str:
    """Language that shown markup declares, or an empty string. Tags don't overlap, so this is linear."""
    for tag in _HTML.finditer(page):
        if found := _LANG.search(tag[1]):
            return found[1].lower()
    return ""


def trigrams(text: str) -> np.ndarray:
    """Hash buckets of the trigrams of lower-cased text, white space as one space."""
    text = f" {' '.join(text.lower().split())} "
    if len(text) < 3:
        return np.empty(0, np.int64)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:]
    return (((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


class Model:
    """Languages and log probabilities of trigram buckets, a row for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.log = np.log((counts + ADDED) / (counts.sum(axis=1, keepdims=True) + ADDED * BUCKETS)) if len(languages) else np.zeros((0, BUCKETS))

    def evidence(self, text: str) -> list[float]:
        """Log likelihoods of the languages, the best 0, damped as trigrams overlap and repeat."""
        own = trigrams(text)
        if not len(own) or not self.languages:
            return [0.0] * len(self.languages)
        total = self.log[:, own].sum(axis=1) / TEMPER
        return (total - total.max()).tolist()


def train(docs: DataFrame, max_docs: int = 4000, max_languages: int = 256) -> Model:
    """A model from docs (doc_id, text, lang); max_docs bounds the sample. Every language is learned; where there are more
    than max_languages, a row of BUCKETS numbers for each would not fit the workers, and a ValueError says so."""
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    n = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()}
    languages = sorted(n)
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} values of lang: clean the labels or raise max_languages")
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, max_docs / len(languages) / n[k]))])
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20) < share[F.col("lang")]).select("text", "lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                if lang in n:
                    total[languages.index(lang)] += np.bincount(trigrams(text), minlength=BUCKETS)
        k, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(bucket, pa.int64()), pa.array(total[k, bucket], pa.int64())], ["k", "bucket", "n"])

    got = sample.mapInArrow(counted, "k long, bucket long, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), BUCKETS))
    counts[got.column("k").to_numpy(), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return Model(languages, counts)


def _read(model: Model):
    names = ["page_id", "doc_id", "host", "domain", "declared", "suffix", "evidence"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for url, page in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                m, page = _ADDRESS.match(url), shown(page)
                host = m[1].lower() if m else ""
                labels = host.split(".")
                first = (m[2] or "").lower() if m else ""
                number = _NUMBER.search((m[2] or "") + m[3]) if m else None
                suffix = f"/{first[:2]}" if re.fullmatch(r"[a-z]{2}(-[a-z]{2})?", first) else f".{labels[-1]}" if host else ""
                rows.append((int(number[1]) if number else None, host, ".".join(labels[-2:]), declared(page), suffix, model.evidence(visible(page))))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64())]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return read


def identify(pages: DataFrame, model: Model) -> DataFrame:
    """pages (page_id, url, html) to page_id, doc_id (the number that ends the path, if any), host, declared, suffix,
    text_lang, lang and confidence (the posterior of lang)."""
    bounded_batches(pages.sparkSession)
    k = len(model.languages)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    read = source.mapInArrow(_read(model), "page_id long, doc_id long, host string, domain string, declared string, suffix string, evidence array<double>")
    out = ["page_id", "doc_id", "host", "declared", "suffix", "text_lang", "lang", "confidence"]
    if not k:
        return read.select(*[F.col(c) if c in read.columns else F.lit(None).cast("double" if c == "confidence" else "string").alias(c) for c in out])
    # The language of the text alone; none where the text says nothing.
    best = F.when(F.exists("evidence", lambda x: x < 0), (F.array_position("evidence", F.array_max("evidence")) - 1).cast("int"))
    read = written(read.withColumn("best", best), "page-evidence")
    vector = F.array(*[F.count(F.when(F.col("best") == i, 1)).cast("double") for i in range(k)])
    zero = F.array(*[F.lit(0.0)] * k)
    every = read.agg(vector.alias("v")).first()["v"]
    share = [(x + 1) / (sum(every) + k) for x in every]
    wide = F.array(*map(F.lit, share))
    count = lambda *c: read.groupBy(*c).agg(vector.alias(f"n_{c[-1]}"))
    add = lambda a, b, f: F.zip_with(a, b, f)
    own = F.array(*[F.when(F.col("best") == i, 1.0).otherwise(0.0) for i in range(k)])
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    # Rates of a declaration or suffix in each language, with what was never seen held likely enough to be an error.
    rates = {}
    for c in ("declared", "suffix"):
        spare = F.lit(ADDED * (read.agg(F.approx_count_distinct(c)).first()[0] + 1))
        of_all = F.transform(F.array(*map(F.lit, every)), lambda x: x + spare)  # noqa: B023
        rates[c] = count(c).select(c, F.zip_with(f"n_{c}", of_all, lambda x, n: F.log((x + ADDED) / n)).alias(f"log_{c}"))
    joined = read.join(count("domain", "host"), ["domain", "host"]).join(count("domain"), "domain").join(rates["declared"], "declared").join(rates["suffix"], "suffix")
    joined = joined.withColumn("own", own)
    less = lambda n: add(F.col(n), F.col("own"), lambda x, y: x - y)
    joined = joined.withColumn("n_domain", less("n_domain")).withColumn("n_host", less("n_host"))
    smooth = lambda n, p: F.zip_with(n, p, lambda x, y: x + PRIOR * y)
    joined = joined.withColumn("p", F.transform(smooth("n_domain", wide), lambda x: x / (total(F.col("n_domain")) + PRIOR)))
    joined = joined.withColumn("p", F.transform(smooth("n_host", F.col("p")), lambda x: x / (total(F.col("n_host")) + PRIOR)))
    silent = F.lit(0.0)
    told = F.when(F.col("declared") == "", zero).otherwise(F.col("log_declared"))
    at = F.when(F.col("suffix") == "", zero).otherwise(F.col("log_suffix"))
    sums = add(add(add("evidence", told, lambda a, b: a + b), at, lambda a, b: a + b), F.transform("p", lambda x: F.log(x)), lambda a, b: a + b)
    joined = joined.withColumn("sum", sums).withColumn("top", F.array_max("sum"))
    names = F.array(*map(F.lit, model.languages))
    name = lambda i: F.get(names, i.cast("int"))
    spread = F.aggregate("sum", silent, lambda a, x: a + F.exp(x - F.col("top")))
    return joined.select("page_id", "doc_id", "host", "declared", "suffix", name(F.col("best")).alias("text_lang"), name(F.array_position("sum", F.col("top")) - 1).alias("lang"), (1 / spread).alias("confidence"))
