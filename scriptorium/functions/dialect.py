"""SQL text in two dialects: the engine's own, and that of the database which checks it.

Only the spelling of functions differs here; what an operator computes is stated where it is used.
"""

from __future__ import annotations

from scriptorium.functions.text import WORD


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def let(value: str, name: str, body: str) -> str:
    """Spark SQL of ``body`` with ``value`` computed once, also where the body reads it inside a function over an array."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


class Spark:
    """Spark SQL."""

    name = "spark"

    def text(self, value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    def words(self, values: list[str]) -> str:
        return ", ".join(map(self.text, values))

    def pattern(self, regex: str) -> str:
        """A word's edge counts ASCII letters, digits and _ only, as in the checking database; the engine's own sees other letters too."""
        return self.text(regex.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"))

    def filter(self, array: str, name: str, test: str) -> str:
        return f"filter({array}, {name} -> {test})"

    def map(self, array: str, name: str, value: str) -> str:
        return f"transform({array}, {name} -> {value})"

    def size(self, array: str) -> str:
        return f"size({array})"

    def at(self, array: str, index: str) -> str:
        """From 1; null outside."""
        return f"get({array}, ({index}) - 1)"

    def part(self, array: str, start: str, length: str) -> str:
        return f"slice({array}, {start}, {length})"

    def upto(self, n: str) -> str:
        """1 .. n."""
        return f"if({n} >= 1, sequence(1, cast({n} as int)), cast(array() as array<int>))"

    def total(self, array: str) -> str:
        return f"aggregate({array}, 0D, (acc_, x_) -> acc_ + x_)"

    def mean(self, array: str) -> str:
        return f"({self.total(array)} / nullif(size({array}), 0))"

    def distinct(self, array: str) -> str:
        return f"array_distinct({array})"

    def join(self, array: str, by: str) -> str:
        return f"array_join({array}, {self.text(by)})"

    def matches(self, text: str, pattern: str) -> str:
        return f"({text} rlike {self.pattern(pattern)})"

    def replace(self, text: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({text}, {self.pattern(pattern)}, {self.text(by)})"

    def split(self, text: str, pattern: str) -> str:
        return f"split({text}, {self.pattern(pattern)})"

    def tokens(self, text: str) -> str:
        return self.filter(f"regexp_extract_all(lower({text}), {self.text(WORD)}, 0)", "t_", self.matches("t_", r"[\p{L}\p{N}]"))

    def cased_tokens(self, text: str) -> str:
        return self.filter(f"regexp_extract_all({text}, {self.text(WORD)}, 0)", "t_", self.matches("t_", r"[\p{L}\p{N}]"))

    def sentences(self, text: str, follow: str = "\"')") -> str:
        """Splitter A; without the apostrophe in ``follow``, B."""
        marked = f"regexp_replace({text}, {self.text(rf'([.!?])([\s{follow}]|$)')}, concat('$1', char(1), '$2'))"
        parts = self.map(f"split({marked}, char(1))", "s_", self.replace("s_", r"^\s+|\s+$"))
        return self.filter(parts, "s_", f"s_ <> '' and ({self.matches('s_', '[.!?]$')} or {self.matches('s_', r'\s')})")

    def bytes(self, text: str) -> str:
        return f"octet_length({text})"

    def variance(self, array: str) -> str:
        """Of the population."""
        squares = self.total(self.map(array, "v_", "(v_ - m_) * (v_ - m_)"))
        return f"({let(self.mean(array), 'm_', squares)} / nullif(size({array}), 0))"

    def sample_variance(self, array: str) -> str:
        return f"({self.variance(array)} * size({array}) / nullif(size({array}) - 1, 0))"


class Duck:
    """The checking database's SQL."""

    name = "duck"

    def text(self, value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    words = Spark.words

    def filter(self, array: str, name: str, test: str) -> str:
        return f"list_filter({array}, lambda {name}: {test})"

    def map(self, array: str, name: str, value: str) -> str:
        return f"list_transform({array}, lambda {name}: {value})"

    def size(self, array: str) -> str:
        return f"len({array})"

    def at(self, array: str, index: str) -> str:
        return f"({array})[{index}]"

    def part(self, array: str, start: str, length: str) -> str:
        return f"({array})[CAST({start} AS BIGINT) : CAST({start} AS BIGINT) + CAST({length} AS BIGINT) - 1]"

    def upto(self, n: str) -> str:
        return f"range(1, CAST({n} AS BIGINT) + 1)"

    def total(self, array: str) -> str:
        return f"coalesce(list_sum({array}), 0.0)"

    def mean(self, array: str) -> str:
        return f"list_avg({array})"

    def distinct(self, array: str) -> str:
        return f"list_distinct({array})"

    def join(self, array: str, by: str) -> str:
        return f"array_to_string({array}, {self.text(by)})"

    def matches(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, {self.text(pattern)})"

    def replace(self, text: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({text}, {self.text(pattern)}, {self.text(by)}, 'g')"

    def split(self, text: str, pattern: str) -> str:
        return f"regexp_split_to_array({text}, {self.text(pattern)})"

    def tokens(self, text: str) -> str:
        return self.filter(f"regexp_extract_all(lower({text}), {self.text(WORD)})", "t_", self.matches("t_", r"[\p{L}\p{N}]"))

    def cased_tokens(self, text: str) -> str:
        return self.filter(f"regexp_extract_all({text}, {self.text(WORD)})", "t_", self.matches("t_", r"[\p{L}\p{N}]"))

    def sentences(self, text: str, follow: str = "\"')") -> str:
        marked = f"regexp_replace({text}, {self.text(rf'([.!?])([\s{follow}]|$)')}, '\\1' || chr(1) || '\\2', 'g')"
        parts = self.map(f"string_split({marked}, chr(1))", "s_", self.replace("s_", r"^\s+|\s+$"))
        return self.filter(parts, "s_", f"s_ <> '' and ({self.matches('s_', '[.!?]$')} or {self.matches('s_', r'\s')})")

    def bytes(self, text: str) -> str:
        return f"strlen({text})"

    def variance(self, array: str) -> str:
        return f"list_var_pop({array})"

    def sample_variance(self, array: str) -> str:
        return f"list_var_samp({array})"


Dialect = Spark | Duck
SPARK, DUCK = Spark(), Duck()
