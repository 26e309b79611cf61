"""Expressions that differ between Spark SQL and the oracle's SQL; every plan is a function of a dialect.

Randomness is counter-based: a uniform is a hash of (seed, stream, path, step, draw), so results do not depend on
partitions, legs of a comparison share their draws, and the oracle can repeat them.
"""

from __future__ import annotations


class Dialect:
    name = ""

    def uniform(self, *key) -> str:
        raise NotImplementedError

    def normal(self, *key) -> str:
        """Box-Muller."""
        return f"(sqrt(-2 * ln({self.uniform(*key, repr('a'))})) * cos(2 * pi() * {self.uniform(*key, repr('b'))}))"

    @staticmethod
    def cdf(x: str) -> str:
        """Normal distribution function by Abramowitz and Stegun 26.2.17; error below 7.5e-8."""
        k = f"(1 / (1 + 0.2316419E0 * abs({x})))"
        poly = f"({k} * (0.319381530E0 + {k} * (-0.356563782E0 + {k} * (1.781477937E0 + {k} * (-1.821255978E0 + {k} * 1.330274429E0)))))"
        tail = f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {poly})"
        return f"(CASE WHEN ({x}) >= 0 THEN 1 - {tail} ELSE {tail} END)"

    @staticmethod
    def pdf(x: str) -> str:
        return f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()))"


    @staticmethod
    def ppf(u: str) -> str:
        """Inverse of the normal distribution function by Acklam's rational approximation; relative error below 1.2e-9."""
        # The published coefficients.
        a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
        b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
        c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
        d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

        def horner(x: str, k) -> str:
            out = f"CAST({k[0]!r} AS DOUBLE)"
            for v in k[1:]:
                out = f"(({out}) * {x} + CAST({v!r} AS DOUBLE))"
            return out

        tail = lambda p: f"{horner(p, c)} / {horner(p, d)}"
        low, high, q = f"sqrt(-2 * ln({u}))", f"sqrt(-2 * ln(1 - {u}))", f"({u} - 0.5E0)"
        return f"(CASE WHEN {u} < 0.02425E0 THEN {tail(low)} WHEN {u} > 0.97575E0 THEN -{tail(high)} ELSE {q} * {horner(f'({q} * {q})', a)} / {horner(f'({q} * {q})', b)} END)"


class Spark(Dialect):
    name = "spark"

    def uniform(self, *key) -> str:
        return f"((CAST(conv(substr(md5(concat_ws(':', {', '.join(f'CAST({k} AS STRING)' for k in key)})), 1, 12), 16, 10) AS DOUBLE) + 0.5E0) / 281474976710656E0)"

    def rows(self, n: int, name: str) -> str:
        return f"(SELECT CAST(id AS BIGINT) AS {name} FROM range(0, {n}))"

    def steps(self, n: int, name: str) -> str:
        return f"(SELECT explode(sequence(1, {n})) AS {name})"

    def quantile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p}E0)"

    def day(self, x: str) -> str:
        return f"CAST({x} AS DATE)"

    def days_after(self, x: str, n) -> str:
        return f"date_add({x}, {n})"

    def json(self, x: str, field: str) -> str:
        return f"get_json_object({x}, '$.{field}')"

    def seconds(self, x: str) -> str:
        return f"unix_seconds(CAST({x} AS TIMESTAMP))"

    def fixed(self, x: str, digits: int) -> str:
        return f"format_string('%.{digits}f', CAST({x} AS DOUBLE))"

    def epoch_day(self, x: str) -> str:
        return f"CAST(unix_date({x}) AS BIGINT)"

    def size(self, x: str) -> str:
        return f"size({x})"

    def item(self, x: str, index: str) -> str:
        return f"element_at({x}, CAST({index} AS INT))"

    def xor(self, a: str, b: str) -> str:
        return f"({a} ^ {b})"

    def fold(self, name: str, source: str, state: dict, move: dict, steps: int, keep: list[str]) -> str:
        """Relation ``name`` of the state after all steps: a fold within the row."""
        read = {k: f"a.{k}" for k in state}
        init = ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in state.items())
        after = ", ".join(f"'{k}', CAST({move[k].format(**read, step='step')} AS DOUBLE)" for k in state)
        return f"{name} AS (SELECT path, f.* FROM (SELECT path, aggregate(sequence(1, {steps}), named_struct({init}), (a, step) -> named_struct({after})) AS f FROM {source} q) w)"


class Duck(Dialect):
    name = "duckdb"

    def uniform(self, *key) -> str:
        return f"((CAST(CAST(concat('0x', substr(md5(concat_ws(':', {', '.join(f'CAST({k} AS VARCHAR)' for k in key)})), 1, 12)) AS BIGINT) AS DOUBLE) + 0.5E0) / 281474976710656E0)"

    def rows(self, n: int, name: str) -> str:
        return f"(SELECT CAST(range AS BIGINT) AS {name} FROM range(0, {n}))"

    def steps(self, n: int, name: str) -> str:
        return f"(SELECT CAST(range AS INTEGER) AS {name} FROM range(1, {n + 1}))"

    def quantile(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def day(self, x: str) -> str:
        return f"CAST({x} AS DATE)"

    def days_after(self, x: str, n) -> str:
        return f"CAST({x} + CAST({n} AS INTEGER) AS DATE)"

    def json(self, x: str, field: str) -> str:
        return f"json_extract_string({x}, '$.{field}')"

    def seconds(self, x: str) -> str:
        return f"CAST(floor(epoch({x})) AS BIGINT)"

    def fixed(self, x: str, digits: int) -> str:
        return f"printf('%.{digits}f', CAST({x} AS DOUBLE))"

    def epoch_day(self, x: str) -> str:
        return f"CAST(date_diff('day', DATE '1970-01-01', {x}) AS BIGINT)"

    def size(self, x: str) -> str:
        return f"len({x})"

    def item(self, x: str, index: str) -> str:
        return f"list_extract({x}, CAST({index} AS BIGINT))"

    def xor(self, a: str, b: str) -> str:
        return f"xor({a}, {b})"

    def fold(self, name: str, source: str, state: dict, move: dict, steps: int, keep: list[str]) -> str:
        """The same by a recursive relation."""
        read = {k: k for k in state}
        kept = "".join(f", {k}" for k in keep)
        init = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in state.items())
        after = ", ".join(f"CAST({move[k].format(**read, step='(step + 1)')} AS DOUBLE) AS {k}" for k in state)
        walk = f"SELECT path, 0 AS step{kept}, {init} FROM {source} q UNION ALL SELECT path, step + 1 AS step{kept}, {after} FROM {name}_r WHERE step < {steps}"
        return f"{name}_r AS ({walk}), {name} AS (SELECT path, {', '.join(state)} FROM {name}_r WHERE step = {steps})"


SPARK, DUCK = Spark(), Duck()
