"""The few expressions that Spark SQL and the checking SQL engine spell differently.

Operators are written once as SQL expressions over a dialect.  Catalyst compiles
them to window and aggregate plans; the other dialect only serves to check them.
"""

from __future__ import annotations

KEY, DATE = "ts_code", "trade_date"
BY_CODE = f"PARTITION BY {KEY} ORDER BY {DATE}"
BY_DATE = f"PARTITION BY {DATE} ORDER BY {KEY}"


class Spark:
    quote = "`{}`".format

    @staticmethod
    def pct(x: str, q: float) -> str:
        """Exact percentile with linear interpolation."""
        return f"percentile({x}, {q})"

    @staticmethod
    def corr(x: str, y: str, over: str = "") -> str:
        """Pearson's correlation, null where one side does not vary: the built-in one divides by 0 there, an error in ANSI mode."""
        a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
        return f"(covar_pop({a}, {b}) {over} / nullif(sqrt(var_pop({a}) {over} * var_pop({b}) {over}), 0))"

    @staticmethod
    def skew(x: str) -> str:
        """Population skewness."""
        return f"skewness({x})"

    @staticmethod
    def kurt(x: str) -> str:
        """Population excess kurtosis."""
        return f"kurtosis({x})"

    @staticmethod
    def last(x: str, over: str) -> str:
        return f"last_value({x}) IGNORE NULLS OVER ({over})"

    @staticmethod
    def first(x: str, over: str) -> str:
        return f"first_value({x}) IGNORE NULLS OVER ({over})"

    @staticmethod
    def values(x: str, over: str) -> str:
        """The values of a frame that are not null, as an array."""
        return f"collect_list({x}) OVER ({over})"

    @staticmethod
    def count_in(array: str, test: str) -> str:
        """Number of elements v of an array that satisfy a test on v."""
        return f"size(filter({array}, v -> {test}))"

    @staticmethod
    def months(date: str, n: int) -> str:
        return f"add_months({date}, {n})"

    @staticmethod
    def days(later: str, earlier: str) -> str:
        return f"datediff({later}, {earlier})"

    @staticmethod
    def minus_days(date: str, n: int) -> str:
        return f"date_sub({date}, {n})"


class Duck:
    quote = '"{}"'.format
    last = staticmethod(lambda x, over: f"last_value({x} IGNORE NULLS) OVER ({over})")
    first = staticmethod(lambda x, over: f"first_value({x} IGNORE NULLS) OVER ({over})")
    pct = staticmethod(lambda x, q: f"quantile_cont({x}, {q})")
    months = staticmethod(lambda date, n: f"({date} + INTERVAL ({n}) MONTH)::DATE")
    days = staticmethod(lambda later, earlier: f"({later} - {earlier})")
    minus_days = staticmethod(lambda date, n: f"({date} - {n})")
    values = staticmethod(lambda x, over: f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER ({over})")
    count_in = staticmethod(lambda array, test: f"coalesce(len(list_filter({array}, lambda v: {test})), 0)")
    corr = staticmethod(lambda x, y, over="": f"corr({x}, {y}) {over}")
    skew = None
    kurt = None


def rows(n: int, order: str = BY_CODE, end: int = 0) -> str:
    """Frame of n rows that ends so many rows before the current one."""
    stop = "CURRENT ROW" if end == 0 else f"{end} PRECEDING"
    return f"{order} ROWS BETWEEN {n - 1 + end} PRECEDING AND {stop}"


def so_far(order: str = BY_CODE) -> str:
    return f"{order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def ratio(a: str, b: str) -> str:
    """a / b, null where b is 0."""
    return f"(({a}) / nullif({b}, 0))"


def finite(x: str) -> str:
    """x, null where it is not a number."""
    return f"nullif({x}, CAST('NaN' AS DOUBLE))"
