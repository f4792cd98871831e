"""Column expressions. All are JVM-side but for shingles, MinHash signatures and band keys, which are Arrow functions over whole batches."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from _md5 import md5 as _md5  # less overhead a call than OpenSSL's
except ImportError:
    _md5 = hashlib.md5

#: Fixed value: the modulus of the portable hash family, the largest prime under 2**32.
PRIME = 4_294_967_291


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def words(text: Column) -> Column:
    """The tokens as one string, blanks between them (there may be one at either end)."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")


def _shingles(seqs: pa.Array, k: int) -> pa.Array:
    items = seqs.flatten().to_pylist()
    size = [0 if n is None else n for n in pc.list_value_length(seqs).to_pylist()]
    out, ends, at = [], [0], 0
    for n in size:
        t = items[at : at + n]
        out.extend(dict.fromkeys(map("|".join, zip(*(t[i:] for i in range(k))))))
        ends.append(len(out))
        at += n
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.string()))


def shingles(seq: Column, k: int = 5) -> Column:
    """Distinct runs of k tokens, joined by |; none for shorter sequences.

    In an Arrow function: Spark interprets array lambdas and puts the expression of the sequence into them, to be worked out for each run.
    """
    if k <= 0:
        raise ValueError("k must be positive")

    @F.arrow_udf("array<string>")
    def runs(a: pa.Array) -> pa.Array:
        return _shingles(a, k)

    return runs(seq)


def hash_words(s: Column) -> Column:
    """Two 32-bit words of a string's md5, which DuckDB computes alike."""
    word = lambda at: F.conv(F.substring(F.md5(s), at, 8), 16, 10).cast("bigint")
    return F.struct(word(1).alias("a"), word(9).alias("b"))


def _minima(word: np.ndarray, at: np.ndarray, num_perm: int) -> np.ndarray:
    """Minima of (a + i * b) mod PRIME for each i and each run of words (a, b) that starts in `at`. Steps from i to i + 1 are additions."""
    x, b = (np.ascontiguousarray(word[:, c]).astype(np.uint64) % np.uint64(PRIME) for c in (0, 1))
    out, less = np.empty((len(at), num_perm), np.int64), np.empty_like(x)
    for i in range(num_perm):
        out[:, i] = np.minimum.reduceat(x, at)
        np.add(x, b, out=x)
        np.subtract(x, np.uint64(PRIME), out=less)  # wraps to a large number below PRIME
        np.minimum(x, less, out=x)
    return out


def _signatures(items: pa.Array, num_perm: int) -> pa.Array:
    size = np.array([0 if x is None else x for x in pc.list_value_length(items).to_pylist()], np.int64)
    digests = b"".join(hashlib.md5(s.encode()).digest()[:8] for s in items.flatten().to_pylist())
    word = np.frombuffer(digests, ">u4").reshape(-1, 2)
    out = np.full((len(items), num_perm), PRIME, np.int64)
    some, at = np.flatnonzero(size), (np.cumsum(size) - size)[size > 0]
    if len(some):
        out[some] = _minima(word, at, num_perm)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(items) + 1, dtype=np.int32) * num_perm), pa.array(out.ravel()))


def minhash(items: Column, num_perm: int = 128) -> Column:
    """Minima of (a + i * b) mod PRIME over the items, one for each permutation i: no explode, no shuffle. Empty sets give PRIME.

    Spark interprets array lambdas, which made this the slowest step by far; an Arrow function does the same on whole batches.
    """

    @F.arrow_udf("array<bigint>")
    def signature(a: pa.Array) -> pa.Array:
        return _signatures(a, num_perm)

    return signature(items)


def _band_keys(signatures: pa.Array, bands: int) -> pa.Array:
    sigs = signatures.to_pylist()
    keys = []
    for sig in sigs:
        words = [str(x) for x in sig]
        rows = len(words) // bands
        keys += [hashlib.md5(",".join(words[b * rows : (b + 1) * rows]).encode()).hexdigest() for b in range(bands)]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * bands), pa.array(keys, pa.string()))


def band_keys(signature: Column, bands: int = 32, num_perm: int = 128) -> Column:
    """The md5 of each band's numbers, as DuckDB computes it too; in an Arrow function, as array lambdas are interpreted."""
    if num_perm % bands:
        raise ValueError("bands must divide the number of permutations")

    @F.arrow_udf("array<string>")
    def keys(a: pa.Array) -> pa.Array:
        return _band_keys(a, bands)

    return keys(signature)


#: Shingles whose hashes are worked on at once.
SLICE = 16_384


def word_shingles(words: str, k: int) -> dict[str, None]:
    """The distinct shingles of words that blanks divide."""
    t = words.split()
    return dict.fromkeys(map("|".join, zip(*(t[i:] for i in range(k)))))


def _marks(words: pa.Array, k: int, num_perm: int, bands: int) -> pa.Array:
    lengths, sizes, sums, sigs = [], [], [], []
    digests: list[bytes] = []
    pending: list[int] = []

    def flush() -> None:
        size = np.array(pending, np.int64)
        raw, at = b"".join(digests), (np.cumsum(size) - size)[size > 0]
        total, sig = np.zeros((len(size), 2), np.uint64), np.zeros((len(size), num_perm), np.uint32)
        if len(at):
            total[size > 0] = np.add.reduceat(np.frombuffer(raw, "<u8").reshape(-1, 2), at, axis=0)
            sig[size > 0] = _minima(np.frombuffer(raw, ">u4").reshape(-1, 4)[:, :2], at, num_perm)
        sums.append(np.concatenate([total, size[:, None].astype(np.uint64)], axis=1))
        sigs.append(sig[size > 0])
        digests.clear()
        pending.clear()

    for s in words.to_pylist():
        found = word_shingles(s, k)
        digests += [_md5(x.encode()).digest() for x in found]
        lengths.append(len(s.split()))
        sizes.append(len(found))
        pending.append(len(found))
        if len(digests) >= SLICE:
            flush()
    flush()
    width = 4 * num_perm // bands
    fixed = lambda raw, n, w: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * w).astype(np.int32)), pa.py_buffer(raw)])
    n, full = len(words), np.cumsum([0, *((x > 0) * bands for x in sizes)]).astype(np.int32)
    keys = pa.ListArray.from_arrays(pa.array(full), fixed(np.concatenate(sigs).tobytes(), int(full[-1]), width))
    return pa.StructArray.from_arrays([pa.array(lengths, pa.int64()), fixed(np.concatenate(sums).tobytes(), n, 24), keys], names=["n", "c", "bands"])


def marks(words: Column, k: int = 5, num_perm: int = 128, bands: int = 32) -> Column:
    """Of words that blanks divide: n, their number; c, equal for equal sets of shingles; bands, the numbers of each band as 4 bytes each, none without shingles.

    c has the number of shingles and the sums of their md5 digests' halves. Shingles themselves, many times the text, never leave the function.
    """
    if k <= 0 or num_perm % bands:
        raise ValueError("k must be positive, and bands must divide the number of permutations")

    @F.arrow_udf("struct<n: bigint, c: binary, bands: array<binary>>")
    def found(a: pa.Array) -> pa.Array:
        return _marks(a, k, num_perm, bands)

    return found(words)


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two arrays of distinct items. `empty` is the value for two empty sets; the scores take 0, the distance takes 1."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(float(empty))).otherwise(both / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, eps: float = 0.0) -> Column:
    """0 for empty or zero vectors."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / (scale + eps)).otherwise(0.0)


def l2_normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language(path: Column) -> Column:
    """By extension; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "py", "python").when(ext.isin("c", "h"), "c").when(ext.isin("cpp", "cc", "cxx", "hpp", "hh", "hxx"), "cpp").when(ext == "java", "java")


# Function-pair scoring


def is_driver_name(name: Column) -> Column:
    n = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return n.isin("<module>", "__main__", "main") | n.startswith("test_") | n.startswith("benchmark_")


def is_template_name(name: Column) -> Column:
    n = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return (n == "<module>") | n.startswith("__obf_") | n.startswith("_obf_")


#: Fixed value: words of an effect tag that mark boilerplate.
TEMPLATE_TAGS = "obfus|template|logging|metric|profil|debug|instrument"


def is_template_func(name: Column, tag: Column, length: Column, degree: Column, calls: Column, soft: int = 64) -> Column:
    n = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    named = is_template_name(name) | n.startswith("safe_bind") | n.startswith("_hidden_") | n.startswith("__obf_") | n.startswith("obf_")
    tagged = F.lower(F.coalesce(tag, F.lit(""))).rlike(TEMPLATE_TAGS)
    return named | tagged | (length <= 3) | ((length <= 8) & ((degree >= soft) | (calls >= 32)))


def plain_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")


def name_factor(a: Column, b: Column) -> Column:
    """1 equal, 0.9 one holds the other, 0.7 three leading characters in common, else 0.4; null if either is blank."""
    x, y = plain_name(a), plain_name(b)
    return F.when((x == "") | (y == ""), F.lit(None).cast("double")).when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.9).when((F.length(x) >= 3) & (F.length(y) >= 3) & (F.substring(x, 1, 3) == F.substring(y, 1, 3)), 0.7).otherwise(0.4)


def length_factor(a: Column, b: Column) -> Column:
    ratio = F.greatest(a, b).cast("double") / F.greatest(F.lit(1), F.least(a, b))
    return F.when(ratio > 8, 0.2).when(ratio > 4, 0.4).when(ratio > 2, 0.7).otherwise(1.0)


def degree_factor(degree: Column) -> Column:
    return F.when(degree >= 128, 0.3).when(degree >= 64, 0.5).when(degree >= 32, 0.8).otherwise(1.0)


def func_pair_score(sim: Column, name_a: Column, name_b: Column, len_a: Column, len_b: Column, deg_a: Column, deg_b: Column, template: Column, threshold: float = 0.6) -> Column:
    """Similarity weighed down by length ratio, names, degrees and template flags."""
    name = F.coalesce(F.lit(0.5) + F.lit(0.5) * name_factor(name_a, name_b), F.lit(1.0))
    s = clamp(sim) * length_factor(len_a, len_b) * name * degree_factor(deg_a) * degree_factor(deg_b) * F.when(template, 0.3).otherwise(1.0)
    capped = lambda x: F.when(is_driver_name(name_a) & is_driver_name(name_b), F.least(x, F.lit(0.8))).otherwise(x)
    kept = lambda x: F.when((x < 1e-4) | (x < 0.5 * threshold), 0.0).otherwise(x)
    # bound by lambdas, as the product would else be written out, and worked out, for each use
    return F.transform(F.transform(F.array(s), capped), kept)[0]


#: Words of a name that say nothing about what a function does.
GENERIC_NAME_WORDS = ("main", "solution", "sol", "helper", "util", "utils", "function", "func", "student", "answer", "result", "res", "tmp")


def name_tokens(name: Column, generic: tuple[str, ...] = GENERIC_NAME_WORDS) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(F.coalesce(name, F.lit("")))), "[^a-z0-9]+"), lambda x: (F.length(x) > 1) & ~x.isin(*generic)))


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0.8 if one starts with the other (three characters at least), else the Jaccard similarity of their words."""
    x, y = F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))
    prefix = (F.length(x) >= 3) & (F.length(y) >= 3) & (x.startswith(y) | y.startswith(x))
    words, other = name_tokens(a), name_tokens(b)
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(prefix, 0.8).when((F.size(words) == 0) | (F.size(other) == 0), 0.0).otherwise(jaccard(words, other))


def effect_tags(text: Column) -> Column:
    """Lower-case tags of a text that lists them; a signature of counts has none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[;,/]"), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def first_number(*values: Column) -> Column:
    """The first of several numbers that is there, else 0: degrees and call counts go by several names."""
    return F.coalesce(*values, F.lit(0)).cast("int")


def effect_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of tags; no tags on a side are no evidence."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(jaccard(F.array_distinct(a), F.array_distinct(b)))


def task_similarity(sim: Column, name: Column, effect: Column) -> Column:
    """Structural similarity let through as far as names and effects agree; nothing if neither does."""
    agree = 0.7 * name + 0.3 * effect
    return F.when((sim <= 0) | (agree <= 0.05), 0.0).otherwise(clamp(clamp(sim) * (0.2 + 0.8 * agree)))


def weighted_program_score(score: Column, len_a: Column, len_b: Column, least: float = 0.0) -> Column:
    """An aggregate: the mean of scores of at least `least`, weighed by the longer side of each pair; 0 without any."""
    w = F.when(score >= least, F.greatest(len_a, len_b))
    return F.coalesce(F.try_divide(F.sum(score * w), F.sum(w)), F.lit(0.0))


def func_similarity(token_jaccard: Column, effect_cosine: Column, unknown: Column, alpha: float = 0.7, penalty: float = 0.05) -> Column:
    return F.greatest(F.lit(0.0), alpha * token_jaccard + (1 - alpha) * effect_cosine - F.when(unknown, penalty).otherwise(0.0))


def inferred_length(*sizes: Column) -> Column:
    """The first positive size, else 1."""
    return F.coalesce(*(F.when(s > 0, s) for s in sizes), F.lit(1))


def damped(x: Column) -> Column:
    return 1.0 / F.greatest(F.lit(2.0), F.log(2.0 + x))


def template_weight(size: Column, files: Column) -> Column:
    """Twice the product of two damped counts, between 0.1 and 0.8."""
    return clamp(2.0 * damped(size) * damped(files), 0.1, 0.8)


def badge(score: Column, threshold: float = 0.6) -> Column:
    return F.when(score >= 0.8, "high").when(score >= threshold, "medium").otherwise("low")


def coverage_score(strong: Column, coverage: Column, average: Column, unmatched: Column, base: Column, min_coverage: float = 0.3) -> Column:
    body = F.greatest(F.lit(0.0), 0.6 * coverage + 0.4 * average - 0.4 * unmatched)
    body = F.when(coverage < min_coverage, body * coverage / min_coverage).otherwise(body)
    return F.when((strong == 0) | (coverage <= 1e-3), 0.0).otherwise(clamp(body + 0.1 * clamp(base) * coverage))


def html_escape(text: Column, quotes: bool = True) -> Column:
    table = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;"), ("'", "&#x27;")] if quotes else [])]
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), table, text)
