"""Detectors over whole files: a rule is a pattern that may span lines, and maybe a guard that silences it.

A file is gated (its size, test folders, its extension), its comments are blanked without moving anything, one
alternation over the rules of its language is tried, and then each rule's matches become findings with line and offsets, unless the
guard has a match within ``radius`` lines of the match (anywhere in the file without a radius). Findings are distinct by (family, path, line).
Files are independent, so this is one pass of Arrow batches without a shuffle; a worker holds one file at a time."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_CHARS = 500_000
FINDING = "path string, line int, start int, end int, family string, cwe string, severity string, snippet string"
_TEST_FOLDER = re.compile(r"(?:^|/)(?:tests?|__tests__|specs?|fixtures)/", re.I)
#: language: (extensions, comment style)
LANGUAGES = {
    "js": ("js jsx ts tsx mjs cjs", "slash"),
    "py": ("py", "hash"),
    "java": ("java kt", "slash"),
    "php": ("php phtml", "both"),
    "go": ("go", "slash"),
    "rb": ("rb", "ruby"),
    "cs": ("cs", "slash"),
    "c": ("c h cc cpp hpp", "slash"),
    "yaml": ("yaml yml", "hash"),
    "tf": ("tf", "both"),
}
_OF_EXTENSION = {e: lang for lang, (es, _) in LANGUAGES.items() for e in es.split()}
_STRING = r"'(?:\\[\s\S]|[^'\\\n])*'?|\"(?:\\[\s\S]|[^\"\\\n])*\"?|`(?:\\[\s\S]|[^`\\])*`?"
_SLASHES, _HASH, _BLOCK = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)", r"#(?!\[)[^\n]*", r"(?m:^)=begin[\s\S]*?(?:\n=end[^\n]*|\Z)"
_COMMENTS = {k: re.compile(f"(?P<keep>{_STRING})|{c}") for k, c in {"slash": _SLASHES, "hash": _HASH, "both": f"{_SLASHES}|{_HASH}", "ruby": f"{_BLOCK}|{_HASH}"}.items()}


@dataclass(frozen=True)
class Rule:
    family: str
    cwe: str
    severity: str
    languages: str
    pattern: str
    guard: str = ""
    radius: int | None = None


def language(path: str) -> str | None:
    return _OF_EXTENSION.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None


def blank_comments(text: str, style: str) -> str:
    """Comments as blanks, line ends kept; what looks like a comment inside a string stays, and a quote that its line doesn't close ends with the line."""
    return _COMMENTS[style].sub(lambda m: m[0] if m["keep"] is not None else re.sub(r"[^\n]", " ", m[0]), text)


class Detector:
    """Rules by language, compiled once a worker."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules: dict[str, list[tuple[Rule, re.Pattern, re.Pattern | None]]] = {}
        for r in rules:
            for lang in r.languages.split():
                self.rules.setdefault(lang, []).append((r, re.compile(r.pattern), re.compile(r.guard) if r.guard else None))
        self.any = {lang: re.compile("|".join(f"(?:{r.pattern})" for r, _, _ in rs)) for lang, rs in self.rules.items()}

    def findings(self, path: str | None, text: str | None) -> list[tuple]:
        """(line, start, end, family, cwe, severity, snippet), by line and family."""
        lang = language(path or "")
        if not text or len(text) > MAX_CHARS or lang not in self.rules or _TEST_FOLDER.search(path):
            return []
        code = blank_comments(text, LANGUAGES[lang][1])
        if not self.any[lang].search(code):
            return []
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        lines, found = text.split("\n"), {}
        for rule, pattern, guard in self.rules[lang]:
            for m in pattern.finditer(code):
                line = bisect.bisect_right(starts, m.start())
                if guard is not None:
                    lo, hi = (0, len(code)) if rule.radius is None else (starts[max(line - 1 - rule.radius, 0)], starts[line + rule.radius] if line + rule.radius < len(starts) else len(code))
                    if guard.search(code, lo, hi):
                        continue
                found.setdefault((line, rule.family), (line, m.start(), m.end(), rule.family, rule.cwe, rule.severity, lines[line - 1].strip()[:200]))
        return [found[k] for k in sorted(found)]


def detect(files: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Findings of files (path, content). Null paths and contents give none."""
    detector = Detector(tuple(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *f) for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) for f in detector.findings(path, text)]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "line", "start", "end", "family", "cwe", "severity", "snippet"])

    return files.select("path", "content").mapInArrow(run, FINDING)
