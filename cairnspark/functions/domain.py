"""Fixed values and column functions of the domain: ratings, grades, weights, identifiers, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RATINGS = {"CC": 2, "C": 1, "N": 0, "I": -1, "II": -2}
KINDS = ["ttp", "tool", "infrastructure", "victimology", "code_overlap", "language_artifact", "metadata", "claim"]
SPOOFABLE = ["code_overlap", "language_artifact", "metadata", "claim"]
MARKER_ORDER = ["code_overlap", "metadata", "language_artifact", "claim"]
RELIABILITY = {"A": 1.0, "B": 0.85, "C": 0.65, "D": 0.45, "E": 0.25, "F": 0.5}
CREDIBILITY = {1: 1.0, 2: 0.85, 3: 0.65, 4: 0.45, 5: 0.25, 6: 0.5}
GRADE_PROBABILITY = {"high": 0.875, "moderate": 0.675, "low": 0.5}
STIX_CONFIDENCE = {"high": 85, "moderate": 50, "low": 15}


def lookup(values: dict, key: Column, default=None) -> Column:
    """A literal map as a column expression; default for keys it lacks."""
    found = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def checked(values: dict, key: Column, what: str) -> Column:
    """lookup() that fails the job on an unknown key."""
    return F.coalesce(
        lookup(values, key), F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(key.cast("string"), F.lit("null"))))
    )


def parse_rating(text: Column) -> Column:
    return checked(RATINGS, F.upper(F.trim(text)), "rating")


def evidence_weight(reliability: Column, credibility: Column, relevance: Column) -> Column:
    return checked(RELIABILITY, reliability, "reliability") * checked(CREDIBILITY, credibility, "credibility") * relevance


def parent_of(item: Column) -> Column:
    """The technique before the first dot."""
    return F.substring_index(item, ".", 1)


def grade_of(probability: Column) -> Column:
    return F.when(probability >= 0.8, "high").when(probability >= 0.55, "moderate").otherwise("low")


def idf(n_groups: Column, usage: Column) -> Column:
    return F.log((1.0 + n_groups) / (1.0 + usage)) + 1.0


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def clean_text(s: Column) -> Column:
    """Without citations, link targets and code tags, white space collapsed; null gives an empty string."""
    s = F.coalesce(s, F.lit(""))
    s = F.regexp_replace(s, r"\(Citation:[^)]*\)", "")
    s = F.regexp_replace(s, r"\[([^\]]*)\]\([^)]*\)", "$1")
    s = F.regexp_replace(s, r"(?s)</?code>", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def norm_key(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def distinctive_words(s: Column, stop: list[str]) -> Column:
    """Lower-cased words of five letters or more of a (camelCase) title, without stop words."""
    spaced = F.regexp_replace(s, "([a-z])([A-Z])", "$1 $2")
    words = F.regexp_extract_all(F.lower(spaced), F.lit("[a-z]{5,}"), F.lit(0))
    return F.array_except(words, F.array(*[F.lit(x) for x in stop]).cast("array<string>"))


def names_in_text(text: Column, name: Column) -> Column:
    """Whether a name of four characters or more stands in the text as whole words, in any case."""
    quoted = F.concat(F.lit(r"(?i)\b\Q"), F.replace(name, F.lit("\\E"), F.lit("")), F.lit(r"\E\b"))
    return (F.length(name) >= 4) & F.rlike(text, quoted)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """The SHA-1 name UUID of a UTF-8 name."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def stix_pattern(kind: Column, value: Column) -> Column:
    """The indicator pattern, or null for kinds that have none."""
    v = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    forms = {
        "ipv4": "[ipv4-addr:value = '", "domain": "[domain-name:value = '", "url": "[url:value = '",
        "sha256": "[file:hashes.'SHA-256' = '", "md5": "[file:hashes.MD5 = '",
    }
    return F.concat(lookup(forms, kind), v, F.lit("']"))


def cypher_literal(s: Column) -> Column:
    """A quoted string literal: backslash and quotes escaped, control characters and line separators as code units."""
    s = F.regexp_replace(s, r"""([\\'"])""", r"\\$1")

    def shown(c: Column) -> Column:
        code = F.ascii(c)
        return F.when(
            (code < 32) | (code == 127) | (c == " ") | (c == " "), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))
        ).otherwise(c)

    plain = ~F.rlike(s, F.lit("[\\x00-\\x1f\\x7f\\u2028\\u2029]"))
    return F.concat(F.lit("'"), F.when(plain, s).otherwise(F.array_join(F.transform(F.split(s, ""), shown), "")), F.lit("'"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; (0, 1) where n is not positive."""
    p = hits / F.nullif(n, F.lit(0))
    d = 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return (
        F.when(n > 0, F.greatest(centre - half, F.lit(0.0))).otherwise(0.0),
        F.when(n > 0, F.least(centre + half, F.lit(1.0))).otherwise(1.0),
    )


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of discordant counts b and c: 2 * sum of C(n, i) / 2^n up to the smaller, 1 at most."""
    n, k = (b + c).cast("double"), F.least(b, c).cast("int")
    steps = lambda first: F.when(k >= first, F.sequence(F.lit(first), k)).otherwise(F.array().cast("array<int>"))
    # The largest term in logarithms, so that no count underflows; the smaller ones as shares of it.
    top = F.aggregate(steps(1), -n * F.log(F.lit(2.0)), lambda a, i: a + F.log((n - i + 1) / i))
    rest = F.aggregate(
        steps(1), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, j: F.struct((a["term"] * (k - j + 1) / (n - k + j)).alias("term"), (a["sum"] + a["term"] * (k - j + 1) / (n - k + j)).alias("sum")),
    )["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(top) * rest))
