"""Small expression helpers shared by all rule layers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space and word characters in the Unicode sense.
SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u001c-\u001f]"
LINE_BREAK = r"[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    The rule expressions refer to intermediate results repeatedly; without the
    binding Catalyst would have to repeat the whole sub-expression each time.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


_expressions: dict[tuple, object] = {}
_owner: list[str] = [""]


def _session_expressions() -> dict[tuple, object]:
    """The finished expressions of the running application; those of an earlier one are dropped."""
    context = SparkContext._active_spark_context
    now = context.applicationId if context else ""
    if _owner[0] != now:
        _expressions.clear()
        _owner[0] = now
    return _expressions


def reused(build: Callable[..., Column]) -> Callable[..., Column]:
    """Build an expression once per session and set of plain arguments.

    Large rule expressions take noticeable time to assemble; a plan that is made again and
    again (one per micro-batch) takes the finished expression.  Only calls whose arguments
    are all plain values (column names, strings, reference data) are remembered.
    """
    @wraps(build)
    def get(*args, **options) -> Column:
        if any(isinstance(a, Column) for a in (*args, *options.values())):
            return build(*args, **options)
        known = _session_expressions()
        key = (build.__module__, build.__name__,
               tuple(a if isinstance(a, (str, int, float)) else id(a) for a in args),
               tuple(sorted((k, v if isinstance(v, (str, int, float)) else id(v))
                            for k, v in options.items())))
        if key not in known:
            columns = [F.col(a) if isinstance(a, str) and i == 0 else a for i, a in enumerate(args)]
            # The arguments stay referenced, so that their ids cannot be taken by others.
            known[key] = (build(*columns, **options), args, options)
        return known[key][0]

    return get


def exploded(df: DataFrame, keep: list, rows: Column, pos: str | None = None) -> DataFrame:
    """One row per struct of an array, with the kept columns and optionally the position.

    The outer form keeps Spark from deriving a filter on the array, which would be pushed
    below the projections and evaluate the whole rule expression a second time.
    """
    kept = df.select(*keep, F.posexplode_outer(rows).alias("_pos", "_row")).where("_row is not null")
    names = kept.columns[:-2]
    place = [F.col("_pos").alias(pos)] if pos else []
    return kept.select(*names, *place, "_row.*")


def _remember(key: tuple, build: Callable[[], Column]) -> Column:
    known = _session_expressions()
    if key not in known:
        known[key] = build()
    return known[key]


def _split_literal(joined: str) -> Column:
    return _remember(("list", joined), lambda: F.split(F.lit(joined), "\n"))


def literals(values: Iterable[str]) -> Column:
    """Array literal of strings (folded to a constant by the optimizer)."""
    return _split_literal("\n".join(values))


def one_of(value: Column, values: Iterable[str]) -> Column:
    """Membership in a bounded list."""
    return F.array_contains(literals(values), value)


def json_literal(data: object, schema: str) -> Column:
    """Nested literal of bounded reference data."""
    text = json.dumps(data)
    return _remember(("json", text, schema), lambda: F.from_json(F.lit(text), schema))


def in_text_list(value: Column, values: Iterable[str]) -> Column:
    """Membership in a longer list by one substring search; values hold no line breaks."""
    joined = "\n" + "\n".join(values) + "\n"
    listed = _remember(("lines", joined), lambda: F.lit(joined))
    return F.contains(listed, F.concat(F.lit("\n"), value, F.lit("\n")))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


_BLANKS = ("\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004"
           "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def codes_array(*pairs: tuple[str, Column]) -> Column:
    """Array of the names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))


def url_unquote(text: Column) -> Column:
    """Percent-decode as UTF-8; ``+`` and broken escapes stay as they are."""
    protected = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")),
                                 r"%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.coalesce(F.try_url_decode(protected), text)
    return F.when(F.contains(text, F.lit("%")), decoded).otherwise(text)


def clean_line(text: Column, limit: int) -> Column:
    """Control characters to spaces, runs of white space collapsed, trimmed, cut."""
    spaced = F.regexp_replace(text, r"[\u0000-\u001f\u007f]+", " ")
    return F.substring(strip(F.regexp_replace(spaced, rf"{SPACE}{{2,}}", " ")), 1, limit)


def logit(p: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1.0 - 1e-9))
    return F.log(clipped / (F.lit(1.0) - clipped))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def weight_map(weights: dict[str, float]) -> Column:
    return json_literal(weights, "map<string,double>")
