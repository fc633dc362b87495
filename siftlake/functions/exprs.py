"""Scalar expressions over records, labels and predictions: plain Columns that stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_hex(content: Column) -> Column:
    """Hex SHA-256 of bytes or text (P01); null stays null."""
    return F.sha2(content.cast("binary"), 256)


def record_id(source: Column, path: Column) -> Column:
    """`<source>-` and the first 12 hex digits of the path's SHA-256."""
    return F.concat_ws("-", source, F.substring(F.sha2(path.cast("binary"), 256), 1, 12))


def text_words(text: Column) -> Column:
    """The distinct words of a whole text, lower-cased; a word is a run of letters and digits of any script."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda x: x != ""))


def word_bits(word: Column) -> Column:
    """60 bits of a word's MD5 as a BIGINT."""
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 15), 16, 10).cast("long")


def difference_bits(vector: Column) -> Column:
    """A BIGINT with a bit for every left neighbour that is larger, first pair highest (P03's array form; 64 values at most)."""
    return F.aggregate(F.sequence(F.lit(1), F.size(vector) - 1), F.lit(0).cast("long"), lambda t, i: t * 2 + F.when(F.get(vector, i - 1) > F.get(vector, i), 1).otherwise(0))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two BIGINT hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex hashes (P04); raises on unequal lengths."""
    half = lambda x, k: F.conv(F.substring(x, k, 8), 16, 10).cast("long")
    d = hamming(half(a, 1), half(b, 1)) + hamming(half(a, 9), half(b, 9))
    return F.when(F.length(a) != F.length(b), F.raise_error(F.lit("hashes of unequal length"))).otherwise(d)


def normalised_name(name: Column) -> Column:
    """Lower case, runs of `_ - .` as one space."""
    return F.regexp_replace(F.lower(name), "[_\\-.]+", " ")


def name_tokens(name: Column, tokens: list[str], original: Column | None = None) -> Column:
    """The given tokens that a normalised name holds, in their order, then `<original class name>`."""
    own = normalised_name(name)
    found = F.filter(F.array(*map(F.lit, tokens)), lambda t: F.contains(own, t))
    if original is None:
        return found
    marked = (original != "") & F.contains(own, F.lower(original))
    return F.concat(found, F.when(marked, F.array(F.concat(F.lit("<"), original, F.lit(">")))).otherwise(F.array().cast("array<string>")))


def size_bucket(width: Column, height: Column) -> Column:
    """`WxH` (P07)."""
    return F.concat_ws("x", width.cast("string"), height.cast("string"))


def label_relation(a: Column, b: Column) -> Column:
    """How two labels relate; a null label is unresolved."""
    return F.when(a.isNull() | b.isNull(), "UNRESOLVED_LABEL").when(a == b, "SAME_LABEL").otherwise("LABEL_CONFLICT")


def risk_level(confidence: Column) -> Column:
    """LOW below 0.50, MODERATE to 0.80, else HIGH; raises outside [0, 1] and on NaN."""
    bad = F.isnan(confidence) | (confidence < 0) | (confidence > 1)
    return F.when(bad, F.raise_error(F.lit("confidence outside [0, 1]"))).when(confidence < 0.5, "LOW").when(confidence <= 0.8, "MODERATE").otherwise("HIGH")


def advice(level: Column, healthy: Column) -> Column:
    """Recommendation by level and class; LOW overrides the class (P10)."""
    return F.when(level == "LOW", "retake").when(healthy, "monitor").when(level == "HIGH", "treat").otherwise("inspect")


def experiment_id(model: Column, fold: Column, arm: Column) -> Column:
    """`{model}_fold{fold:02d}_{arm}`."""
    return F.format_string("%s_fold%02d_%s", model, fold, arm)


def config_hash(**fields: Column) -> Column:
    """SHA-256 of the fields as `name=value` lines, by name (P12): stable bytes whatever the JSON writer."""
    return F.sha2(F.concat_ws("\n", *(F.concat(F.lit(f"{k}="), F.coalesce(fields[k].cast("string"), F.lit("null"))) for k in sorted(fields))), 256)


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda t, y: t + y))


def is_improvement(metric: str, candidate: Column, best: Column) -> Column:
    """Strictly lower for losses, strictly higher otherwise; anything improves on nothing."""
    return F.when(best.isNull(), True).otherwise(candidate < best if "loss" in metric else candidate > best)


def relative_path(path: Column, root: str) -> Column:
    """The path below a root, or unchanged."""
    root = root if root.endswith("/") else root + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def confidence_label(confidence: Column) -> Column:
    """Percent with one decimal."""
    return F.format_string("%.1f%%", confidence * 100)


def train_only(path: Column, forbidden: tuple[str, ...] = ("val", "valid", "validation", "test", "final_test")) -> Column:
    """True if a path lies under `train` and under no held-out part."""
    parts = F.split(F.lower(path), "/")
    return F.array_contains(parts, "train") & ~F.arrays_overlap(parts, F.array(*map(F.lit, forbidden)))


def class_index(label: Column, classes: list[str]) -> Column:
    """0-based place of a label among the declared classes; an undeclared or null one raises."""
    place = F.array_position(F.array(*map(F.lit, classes)), label)
    return F.when(F.coalesce(place, F.lit(0)) == 0, F.raise_error(F.concat(F.lit("undeclared class: "), F.coalesce(label, F.lit("null"))))).otherwise(place - 1).cast("int")


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that holds, '' if none: ordered exclusion."""
    return F.coalesce(reduce(lambda t, r: t.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1])), F.lit(""))


def pipeline_stage(epoch: Column, head_epochs: int, strategy: str = "head_then_full") -> Column:
    """`head` for the first epochs of head_then_full, else `full`."""
    return F.when(F.lit(strategy == "head_then_full") & (epoch <= head_epochs), "head").otherwise("full")
