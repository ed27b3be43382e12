"""One way to write an expression for Spark SQL and for DuckDB, where the two spell functions differently."""

from __future__ import annotations

import re
from collections.abc import Iterable


class Dialect:
    duck = False

    def lit(self, value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def has(self, x: str, words: Iterable[str]) -> str:
        """Any of the words is a substring."""
        return "(" + " or ".join(f"contains({x}, {self.lit(w)})" for w in words) + ")"

    def matches(self, x: str, *patterns: str, ignore_case: bool = False) -> str:
        joined = "|".join(f"(?:{p})" for p in patterns)
        return f"({x} rlike r'(?U){'(?i)' * ignore_case}{joined}')"

    def hit(self, x: str, words: Iterable[str]) -> str:
        """Any of the words: short ones between word boundaries, others as substrings."""
        words = list(words)
        short, long = [w for w in words if len(w) <= 3], [w for w in words if len(w) > 3]
        parts = [self.has(x, long)] * bool(long) + [self.bounded(x, short)] * bool(short)
        return "(" + " or ".join(parts) + ")"

    def bounded(self, x: str, words: Iterable[str]) -> str:
        """Any of the words between word boundaries; few texts hold one as a substring, and only these meet the pattern."""
        words = list(words)
        return f"({self.has(x, words)} and {self._bounded(x, words)})"

    def _bounded(self, x: str, words: list[str]) -> str:
        return self.matches(x, r"\b(?:" + "|".join(re.escape(w).replace(r"\ ", " ").replace(r"\&", "&").replace(r"\-", "-") for w in words) + r")\b")

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, r'(?U){pattern}', {group})"

    def extract_all(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract_all({x}, r'(?U){pattern}', {group})"

    def replace(self, x: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({x}, r'(?U){pattern}', '{by}')"

    def count(self, x: str, pattern: str) -> str:
        return f"regexp_count({x}, r'(?U){pattern}')"

    def array(self, items: Iterable[str]) -> str:
        return f"array({', '.join(items)})"

    def present(self, items: Iterable[tuple[str, str]]) -> str:
        """Values whose condition holds."""
        return f"array_compact({self.array(f'case when {c} then {self.lit(v)} end' for c, v in items)})"

    def where(self, array: str, condition: str) -> str:
        """``condition`` of element x."""
        return f"filter({array}, x -> {condition})"

    def each(self, array: str, value: str) -> str:
        return f"transform({array}, x -> {value})"

    def distinct(self, array: str) -> str:
        return f"array_sort(array_distinct({array}))"

    def plus(self, *arrays: str) -> str:
        return f"concat({', '.join(arrays)})"

    def least(self, array: str) -> str:
        return f"array_min({array})"

    def join(self, array: str, by: str) -> str:
        return f"array_join({array}, '{by}')"

    def split(self, x: str, by: str) -> str:
        """Split at a plain string."""
        return f"split({x}, r'{re.escape(by)}')"

    def size(self, array: str) -> str:
        return f"size({array})"

    def within(self, array: str, value: str) -> str:
        return f"array_contains({array}, {value})"

    def overlap(self, a: str, b: str) -> str:
        return f"arrays_overlap({a}, {b})"

    def whole(self, x: str) -> str:
        """Towards zero."""
        return f"cast({x} as int)"

    def even(self, x: str) -> str:
        """Half to even."""
        return f"cast(rint({x}) as int)"

    def tenth(self, x: str) -> str:
        return f"(rint(({x}) * 10) / 10.0D)"

    def double(self, x: str) -> str:
        return f"{x}D"

    def number(self, x: str) -> str:
        return f"try_cast({x} as double)"

    def seconds(self, x: str) -> str:
        return f"unix_timestamp({x})"

    def decoded(self, x: str) -> str:
        """A part of a form-encoded query, decoded; a percent sign that begins no code stands for itself."""
        return f"url_decode(regexp_replace({x}, r'%(?![0-9A-Fa-f]{{2}})', '%25'))"

    def encoded(self, x: str) -> str:
        """Form encoding, in which letters, digits and ``_.-~`` stand for themselves."""
        return f"replace(replace(url_encode({x}), '*', '%2A'), '%7E', '~')"

    def array_type(self) -> str:
        return "array<string>"


class Duck(Dialect):
    duck = True

    def lit(self, value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def bounded(self, x: str, words: Iterable[str]) -> str:
        return self._bounded(x, list(words))

    def matches(self, x: str, *patterns: str, ignore_case: bool = False) -> str:
        joined = "|".join(f"(?:{p})" for p in patterns)
        return f"regexp_matches({x}, '{'(?i)' * ignore_case}{joined}')"

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def extract_all(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract_all({x}, '{pattern}', {group})"

    def replace(self, x: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def count(self, x: str, pattern: str) -> str:
        return f"cast(len(regexp_extract_all({x}, '{pattern}')) as int)"

    def array(self, items: Iterable[str]) -> str:
        return f"[{', '.join(items)}]"

    def present(self, items: Iterable[tuple[str, str]]) -> str:
        return f"list_filter({self.array(f'case when {c} then {self.lit(v)} end' for c, v in items)}, lambda x: x is not null)"

    def where(self, array: str, condition: str) -> str:
        return f"list_filter({array}, lambda x: {condition})"

    def each(self, array: str, value: str) -> str:
        return f"list_transform({array}, lambda x: {value})"

    def distinct(self, array: str) -> str:
        return f"list_sort(list_distinct({array}))"

    def plus(self, *arrays: str) -> str:
        out = arrays[0]
        for a in arrays[1:]:
            out = f"list_concat({out}, {a})"
        return out

    def least(self, array: str) -> str:
        return f"list_min({array})"

    def join(self, array: str, by: str) -> str:
        return f"array_to_string({array}, '{by}')"

    def split(self, x: str, by: str) -> str:
        return f"string_split({x}, '{by}')"

    def size(self, array: str) -> str:
        return f"cast(len({array}) as int)"

    def within(self, array: str, value: str) -> str:
        return f"list_contains({array}, {value})"

    def overlap(self, a: str, b: str) -> str:
        return f"list_has_any({a}, {b})"

    def whole(self, x: str) -> str:
        return f"cast(trunc({x}) as int)"

    def even(self, x: str) -> str:
        return f"cast(round_even({x}, 0) as int)"

    def tenth(self, x: str) -> str:
        return f"(round_even(({x}) * 10, 0) / 10.0::double)"

    def double(self, x: str) -> str:
        return f"{x}::double"

    def seconds(self, x: str) -> str:
        return f"cast(epoch({x}) as bigint)"

    def decoded(self, x: str) -> str:
        return f"url_decode(replace({x}, '+', ' '))"

    def encoded(self, x: str) -> str:
        return f"replace(url_encode({x}), '%20', '+')"

    def array_type(self) -> str:
        return "varchar[]"


SPARK, DUCK = Dialect(), Duck()
