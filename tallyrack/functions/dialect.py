"""Scalar functions are written once as SQL text for two dialects: Spark's, which the engine plans natively, and
DuckDB's, which only serves as the oracle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Dialect:
    """Null where nothing matches ('' where only the group is missing); patterns ignore case unless said otherwise."""

    def __init__(self, name: str) -> None:
        self.spark = name == "spark"

    @staticmethod
    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def _pattern(self, pattern: str, ignore: bool, anywhere: bool = True) -> str:
        pattern = pattern.replace("'", r"\x27")
        if self.spark:
            return f"r'(?{'i' * ignore}Us){pattern}'"
        return f"'(?s){pattern}'"

    def sub(self, x: str, pattern: str, by: str = "", ignore: bool = True) -> str:
        p = self._pattern(pattern, ignore)
        return f"regexp_replace({x}, {p}, {self.text(by)})" if self.spark else f"regexp_replace({x}, {p}, {self.text(by)}, 'g{'i' * ignore}')"

    def find(self, x: str, pattern: str, group: int = 0, ignore: bool = True) -> str:
        p = self._pattern(pattern, ignore)
        # one mention of x: nullif and CASE repeat it, and nested ones would grow a plan exponentially
        return f"try_element_at(regexp_extract_all({x}, {p}, {group}), 1)" if self.spark else f"nullif(regexp_extract({x}, {p}, {group}, '{'i' if ignore else 'c'}'), '')"

    def match(self, x: str, pattern: str, ignore: bool = True) -> str:
        p = self._pattern(pattern, ignore)
        return f"coalesce(rlike({x}, {p}), false)" if self.spark else f"coalesce(regexp_matches({x}, {p}, '{'i' if ignore else 'c'}'), false)"

    def all(self, x: str, pattern: str, group: int = 0, ignore: bool = True) -> str:
        p = self._pattern(pattern, ignore)
        return f"regexp_extract_all({x}, {p}, {group})" if self.spark else f"regexp_extract_all({x}, {p}, {group}, '{'i' if ignore else 'c'}')"

    def strip(self, x: str, chars: str) -> str:
        return f"btrim({x}, {self.text(chars)})" if self.spark else f"trim({x}, {self.text(chars)})"

    def squeeze(self, x: str) -> str:
        """White space runs to one space, none at the ends."""
        return f"trim({self.sub(x, r'\s+', ' ')})"

    def map(self, x: str, body: str, v: str = "v") -> str:
        """A list with each v made into body."""
        return f"transform({x}, {v} -> {body})" if self.spark else f"list_transform({x}, lambda {v}: {body})"

    def keep(self, x: str, body: str, v: str = "v") -> str:
        return f"filter({x}, {v} -> {body})" if self.spark else f"list_filter({x}, lambda {v}: {body})"

    def join(self, x: str, by: str) -> str:
        return f"array_join({x}, {self.text(by)})" if self.spark else f"array_to_string({x}, {self.text(by)})"

    def head(self, x: str, n: int) -> str:
        return f"slice({x}, 1, {n})" if self.spark else f"list_slice({x}, 1, {n})"

    def at(self, x: str, k: int) -> str:
        """1-based; from the end if negative; null beyond it."""
        return f"try_element_at({x}, {k})" if self.spark else f"list_extract({x}, {k})"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, {self._pattern('[' + by + ']', False)})" if self.spark else f"string_split({x}, {self.text(by)})"

    def size(self, x: str) -> str:
        return f"size({x})" if self.spark else f"len({x})"

    def title(self, x: str) -> str:
        """Upper case where a letter follows none, else lower case."""
        words = self.all(f"lower({x})", "[a-z]+|[^a-z]+", ignore=False)
        return self.join(self.map(words, "upper(substring(v, 1, 1)) || substring(v, 2)"), "")

    def sha1(self, x: str) -> str:
        return f"sha1({x})"

    def case(self, *pairs: tuple[str, str], other: str = "null") -> str:
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"

    def either(self, *ways: str) -> str:
        return f"coalesce({', '.join(ways)})"

    def long(self, x: str) -> str:
        return f"try_cast({x} AS bigint)"

    def double(self, x: str) -> str:
        return f"try_cast({x} AS double)"


SPARK, DUCK = Dialect("spark"), Dialect("duck")


def column(sql: str) -> Column:
    return F.expr(sql)
