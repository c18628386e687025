"""Scalar functions as Columns: redaction, entropy, paths, identities, severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from worst to least.
SEVERITIES = ("critical", "high", "medium", "low", "info")


def severity_rank(severity: Column) -> Column:
    rank = F.lit(9)
    for n, name in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(F.lower(severity) == name, n).otherwise(rank)
    return rank


def short_hash(value: Column, size: int = 16) -> Column:
    return F.substring(F.sha2(value, 256), 1, size)


#: A literal in any quotes, what it becomes, and what counts as white space.
LITERAL = "(['\"`])(?:[^\\\\\\x01]|\\\\.)*?\\1"
_BLANKS = "[\\s\\x0B\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+"


def normal_snippet(text: Column) -> Column:
    """Lower case, literals alike, white space squeezed, commas and semicolons at the end off, 200 characters."""
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), LITERAL, "'_S_'")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, _BLANKS, " "), r"[ ,;]+\z", "")), 1, 200)


def path_hint(path: Column) -> Column:
    """The last two segments of a path."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: p != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")


def rule_id(rule: Column, cwe: Column, family: Column, parser: Column, vuln: Column) -> Column:
    """A finding's rule: its own id, else its CWE, family, or parser and title."""
    set_ = lambda c: F.coalesce(c, F.lit("")) != ""
    title = F.substring(F.coalesce(vuln, F.lit("")), 1, 40)
    return F.when(set_(rule), rule).when(set_(cwe), F.concat(F.lit("cwe:"), cwe)).when(set_(family), F.concat(F.lit("fam:"), family)).when(set_(parser), F.concat(F.lit("parser:"), parser, F.lit(":"), title)).otherwise(F.concat(F.lit("vuln:"), title))


def path_shape(steps: Column) -> Column:
    """type@label of the steps from source to sink (array of structs type, label)."""
    part = lambda s: F.concat(F.coalesce(s["type"], F.lit("")), F.lit("@"), F.coalesce(s["label"], F.lit("")))
    return F.coalesce(F.array_join(F.transform(steps, part), "->"), F.lit(""))


def stable_id(rule: Column, snippet: Column, shape: Column, path: Column) -> Column:
    """A finding's identity that doesn't depend on its line: rule, snippet, shape of its path and its last two folders."""
    return short_hash(F.concat_ws("|", F.coalesce(rule, F.lit("")), normal_snippet(snippet), F.coalesce(shape, F.lit("")), path_hint(path)))


def entropy(token: Column) -> Column:
    """Shannon bits a character."""
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    parts = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: (n - F.size(F.array_remove(chars, c))) / n)
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def route_path(url: Column) -> Column:
    """Scheme, host and query off; parameters and numbers as *; lower case; no slash at the end."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z]+://[^/]*", ""), r"[?#].*$", "")
    parts = F.transform(F.split(F.regexp_replace(path, "^/+|/+$", ""), "/"), lambda s: F.when(s.rlike(r"^(:.*|\{.*\}|<.*>|\*|\$\{.*\}|[0-9]+)$"), F.lit("*")).otherwise(F.lower(s)))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


#: What stands for a secret, and names whose quoted values are secrets.
REDACTED = "[REDACTED-SECRET]"
SECRET_NAMES = "apiKey api_key secret token password passwd client_secret access_key private_key authorization".split()
ENTROPY_LENGTH, ENTROPY_BITS = 24, 4.0
PEM = r"(?i)(-----BEGIN\s+[A-Z0-9 ]*PRIVATE KEY-----)[\s\S]*?(-----END\s+[A-Z0-9 ]*PRIVATE KEY-----)"
CONNECTION = r"(://[^:/\s'\"@]+:)([^@/\s'\"]+)(@)"
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+"
KEY_VALUE = r"(?i)(\b(?:" + "|".join(SECRET_NAMES) + r")\b)(\s*[:=]\s*)(['\"`])([^'\"`]+)\3"
QUOTED = r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`(?:\\.|[^`\\])*`"


def secret_shape(token: Column) -> Column:
    """Long, of base64 characters, and not hex alone."""
    return (F.char_length(token) >= ENTROPY_LENGTH) & token.rlike(r"^[A-Za-z0-9+/_=-]+$") & ~token.rlike("^[0-9a-fA-F]+$")


def high_entropy(token: Column) -> Column:
    """A token that looks like a secret: long, of base64 characters, not hex alone, and of many bits a character."""
    return F.when(secret_shape(token), entropy(token) >= ENTROPY_BITS).otherwise(F.lit(False))


def redact(text: Column) -> tuple[Column, dict[str, Column]]:
    """The text with secrets replaced, one pass after the other, and how many each pass replaced: keys keep their marks, connection strings all but the password, bearer tokens their
    scheme, assignments their name and quotes; last, quoted literals of high entropy."""
    counts = {}
    for name, pattern, put in (("pem", PEM, "$1\n" + REDACTED + "\n$2"), ("connection", CONNECTION, "$1" + REDACTED + "$3"), ("bearer", BEARER, "Bearer " + REDACTED)):
        counts[name] = F.regexp_count(text, F.lit(pattern)).cast("long")
        text = F.regexp_replace(text, pattern, put)
    counts["key_value"] = F.regexp_count(text, F.lit(KEY_VALUE)).cast("long")
    text = F.regexp_replace(F.regexp_replace(text, KEY_VALUE.replace(r"([^'\"`]+)", r"(Bearer\s+)[^'\"`]+"), f"$1$2$3$4{REDACTED}$3"), KEY_VALUE.replace(r"([^'\"`]+)", r"(?!Bearer\s)([^'\"`]+)"), f"$1$2$3{REDACTED}$3")
    found, between = F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0)), F.split(text, QUOTED, -1)
    inner = lambda m: F.substring(m, F.lit(2), F.char_length(m) - 2)
    counts["literal"] = F.size(F.filter(found, lambda m: high_entropy(inner(m)))).cast("long")
    safe = F.transform(found, lambda m: F.when(high_entropy(inner(m)), F.concat(F.substring(m, 1, 1), F.lit(REDACTED), F.substring(m, 1, 1))).otherwise(m))
    text = F.array_join(F.zip_with(between, F.concat(safe, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return text, counts


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval of a share; 0 to 1 without cases."""
    z = 1.959963984540054
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(1.0)
