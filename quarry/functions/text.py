"""Fingerprints of texts, sensitive-data rules, and small parsers."""

from __future__ import annotations

import hashlib
import json
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

SHINGLE = 5
# Parameters of the signature.
PERMUTATIONS, BANDS, PRIME, SEED_NAME = 32, 8, (1 << 61) - 1, "task-minhash-v1"

# The rules' patterns, e-mail exceptions and allowed licences.
SENSITIVE = {
    "private_key": r"-----BEGIN (?:RSA |OPENSSH |EC |DSA )?PRIVATE KEY-----",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{30,}\b|\bgithub_pat_[A-Za-z0-9_]{40,}\b",
    "aws_access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "api_key": r"\bsk-[A-Za-z0-9_-]{24,}\b",
    "credential_url": r"https?://[^\s/:@]+:[^\s/@]{4,}@",
    "credential_assignment": r"""(?i)\b(?:password|api[_-]?key|access[_-]?token|client[_-]?secret)\b\s*[=:]\s*["']([A-Za-z0-9_+/=-]{16,})["']""",
    "email": r"\b[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
}
#: Literals without which a rule can't hold: one of each tuple stands in every text that meets it.  A look for them costs little.
GUARDS = {
    "private_key": [("-----BEGIN ",)], "github_token": [("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")], "aws_access_key": [("AKIA", "ASIA")], "api_key": [("sk-",)], "credential_url": [("://",), ("@",)],
    "credential_assignment": [("=", ":"), ('"', "'")], "email": [("@",)], "ssn": [("-",)],
}
SERVICE_ADDRESS = "openhands@all-hands.dev"
RESERVED_DOMAIN = r"(\.invalid|\.test)$|^(.*\.)?(example\.com|example\.org|example\.net)$"
LICENCES = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause")


def words(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(r"((?U)\w+)"), F.lit(1))


def shingles(folded: Column, words: str) -> Column:
    """Distinct 16-digit hashes of five-word windows of a folded text; of a shorter one its whole digest.

    ``words`` names a column that holds ``words(folded)``: as an expression it would be made again for each window."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: F.substring(F.sha2(F.array_join(F.slice(words, i, SHINGLE), " "), 256), 1, 16))
    return F.when(n < SHINGLE, F.array(F.sha2(folded, 256))).otherwise(F.array_distinct(windows))


def permutations() -> list[tuple[int, int]]:
    """(factor, offset) of each permutation, from its seed name."""
    out = []
    for i in range(PERMUTATIONS):
        seed = hashlib.sha256(f"{SEED_NAME}/{i}".encode()).digest()
        out.append((int.from_bytes(seed[:8], "big") % (PRIME - 1) + 1, int.from_bytes(seed[8:16], "big") % PRIME))
    return out


def _reduce(x: np.ndarray) -> np.ndarray:
    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(61))
    return np.where(x >= p, x - p, x)


def _times(a: int, v: np.ndarray) -> np.ndarray:
    """a * v modulo 2**61 - 1 in 64 bits, by halves of 31 bits (2**61 is 1, so 2**62 is 2)."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    a1, a0, v1, v0 = np.uint64(a >> 31), np.uint64(a & ((1 << 31) - 1)), v >> half, v & low
    cross = a0 * v1 + a1 * v0
    return _reduce(_reduce(a1 * v1 * np.uint64(2) + (cross >> np.uint64(30))) + _reduce(((cross & np.uint64((1 << 30) - 1)) << half) + a0 * v0))


#: Shingles whose signatures are made together.
BLOCK = 1 << 15


def joined_words(folded: Column) -> Column:
    """The words of a folded text, a space between two."""
    return F.array_join(words(folded), " ")


def _hashes(digest: str, text: str) -> np.ndarray:
    """The distinct first 64 bits of ``shingles`` of a text, from its digest and ``joined_words``."""
    data = text.encode()
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    if len(gaps) < SHINGLE - 1:
        return np.array([int(digest[:16], 16)], np.uint64)
    begins, ends, sha = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(data)], hashlib.sha256
    return np.unique(np.frombuffer(b"".join([sha(data[i:j]).digest()[:8] for i, j in zip(begins, ends[SHINGLE - 1 :])]), ">u8").astype(np.uint64))


def _signed(sets: list[np.ndarray]) -> list[list[str]]:
    """Band digests of some non-empty sets of hashes, of whose bits the first 60 count."""
    lengths = np.array(list(map(len, sets)))
    values, at = np.concatenate(sets) >> np.uint64(4), np.cumsum(lengths) - lengths
    mins = [np.minimum.reduceat(_reduce(_times(a, values) + np.uint64(b)), at) for a, b in permutations()]
    rows = PERMUTATIONS // BANDS
    return [[hashlib.sha256(json.dumps(r[i : i + rows], separators=(",", ":")).encode()).hexdigest() for i in range(0, PERMUTATIONS, rows)] for r in np.stack(mins, axis=1).tolist()]


@F.pandas_udf(ArrayType(StringType()))
def minhash_bands(sets: pd.Series) -> pd.Series:
    """Band digests of each non-empty set of hex shingles."""
    return pd.Series([_signed([np.fromiter((int(x[:16], 16) for x in s), np.uint64, len(s))])[0] for s in sets], dtype=object)


def _fingerprints(digests: pd.Series, texts: pd.Series, keep: bool) -> pd.DataFrame:
    kept, sizes, bands, block, size = [], [], [], [], 0
    for digest, text in zip(digests, texts):
        if digest is None:
            raise ValueError("a text without a digest has no fingerprint")
        found = _hashes(digest, text)
        sizes.append(len(found))
        if keep:
            kept.append(found.view(np.int64))
        block.append(found)
        size += len(found)
        if size >= BLOCK:
            bands, block, size = bands + _signed(block), [], 0
    bands += _signed(block) if block else []
    return pd.DataFrame({"n": np.array(sizes, np.int32), "bands": bands} | ({"shingles": kept} if keep else {}))


_SIGNED = [StructField("n", IntegerType()), StructField("bands", ArrayType(StringType()))]


@F.pandas_udf(StructType(_SIGNED))
def signature(digests: pd.Series, texts: pd.Series) -> pd.DataFrame:
    """Of each text, given by its digest and ``joined_words``, how many shingles it has and its MinHash bands."""
    return _fingerprints(digests, texts, False)


@F.pandas_udf(StructType([*_SIGNED, StructField("shingles", ArrayType(LongType()))]))
def fingerprint(digests: pd.Series, texts: pd.Series) -> pd.DataFrame:
    """``signature`` with the shingles, each by its first 64 bits."""
    return _fingerprints(digests, texts, True)


@F.pandas_udf(ArrayType(LongType()))
def shingle_hashes(digests: pd.Series, texts: pd.Series) -> pd.Series:
    """The shingles of ``fingerprint`` alone."""
    return pd.Series([_hashes(d, t).view(np.int64) for d, t in zip(digests, texts)], dtype=object)


def sensitive_findings(text: Column) -> Column:
    """Names of the rules that a text meets, in order of the rules; e-mail addresses of reserved domains don't count."""

    def private(address: Column) -> Column:
        return (F.lower(address) != SERVICE_ADDRESS) & ~F.lower(F.substring_index(address, "@", -1)).rlike(RESERVED_DOMAIN)

    hits = []
    for name, pattern in SENSITIVE.items():
        met = F.exists(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), private) if name == "email" else text.rlike(pattern)
        for literals in reversed(GUARDS[name]):
            met = reduce(lambda a, b: a | b, (text.contains(x) for x in literals)) & met
        hits.append(F.when(met, F.lit(name)))
    return F.array_compact(F.array(*hits))


def normalize_success(value: Column, numeric: bool = False) -> Column:
    """Outcome of a value: true, false or unknown (null).  Texts by their words; of numbers -1 is unknown, zero false."""
    if numeric:
        return F.when(value != -1, value != 0)
    v = F.lower(F.trim(value))
    # Words of the two outcomes.
    good, bad = ("1", "true", "success", "succeeded", "resolved", "passed", "pass"), ("0", "false", "failure", "failed", "unresolved", "error")
    return F.when(v.isin(*good), True).when(v.isin(*bad), False)


def canonical_json(value: Column) -> Column:
    """Sorted, compact JSON of a JSON text without floats (Catalyst prints 1.0 as 1); null where it does not parse."""
    return F.to_json(F.try_parse_json(value))


def canonical(value) -> str:
    """Sorted, compact JSON."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(StringType())
def canonical_json_exact(value: pd.Series) -> pd.Series:
    """Sorted, compact JSON with the number forms of Python's json; null where it does not parse."""

    def one(x):
        try:
            return None if x is None else canonical(json.loads(x))
        except ValueError:
            return None

    return value.map(one)


def split_think(text: Column) -> Column:
    """struct(reasoning, visible): what stands between leading think tags, and the rest."""
    pattern = r"(?sU)\A\s*<think>(.*?)</think>\s*(.*)\z"
    strip = lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    text = F.coalesce(text, F.lit(""))
    has = text.rlike(pattern)
    return F.struct(
        F.when(has, strip(F.regexp_extract(text, pattern, 1))).otherwise("").alias("reasoning"),
        strip(F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(text)).alias("visible"),
    )


# Fixed value: how a fenced block is written.
_FENCE = re.compile(r"```(?:[A-Za-z0-9_+.-]+)?\s*\n?(.*?)```", re.DOTALL)


def last_fence(text: str | None) -> tuple[str, str | None]:
    """(text around the last fenced block, the block's content or None)."""
    text = (text or "").strip()
    found = None
    for found in _FENCE.finditer(text):  # noqa: B007
        pass
    if found is None:
        return text, None
    return (text[: found.start()] + text[found.end() :]).strip(), found.group(1).strip()


def first_json(text: str):
    """The first object or array that decodes from some bracket on, or None."""
    decode = json.JSONDecoder().raw_decode
    for m in re.finditer(r"[\[{]", text):
        try:
            return decode(text, m.start())[0]
        except ValueError:
            pass
    return None
