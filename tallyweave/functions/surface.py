"""The rules as SQL names: temporary functions for numbers, JSON and rewards, and a table function for tool calls."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from .numeric import SCALES

_SCALED = ", ".join(f"{s!r}D" for s in SCALES)

#: Name, parameters, type and body. A body that looks at a parameter more than once binds it by a one-element array.
FUNCTIONS = (
    ("extract_num", "t STRING", "DOUBLE", r"try_cast(nullif(regexp_extract(replace(t, ',', ''), '[-+]?[0-9]*\\.?[0-9]+', 0), '') AS DOUBLE)"),
    ("is_close", "a DOUBLE, b DOUBLE, tol DOUBLE", "BOOLEAN", "coalesce(abs(a - b) / greatest(abs(b), 1e-6D) <= tol, false)"),
    ("numeric_match", "pred STRING, gold STRING, tol DOUBLE", "BOOLEAN", "is_close(extract_num(pred), extract_num(gold), tol)"),
    (
        "scaled_match", "p DOUBLE, percent BOOLEAN, gold STRING, tol DOUBLE", "BOOLEAN",
        # SQL functions can't stand within a lambda, so the comparison is written out
        f"""p IS NOT NULL AND exists(transform(array(named_struct('g', extract_num(gold), 'h', coalesce(contains(gold, '%'), false))), x -> exists(concat(transform(array({_SCALED}), s -> s * p), CASE WHEN coalesce(percent, false) THEN array(p / 100D) ELSE array() END),
        v -> coalesce(abs(v - x.g) / greatest(abs(x.g), 1e-6D) <= tol, false) OR (x.h AND coalesce(abs(v - x.g / 100D) / greatest(abs(x.g / 100D), 1e-6D) <= tol, false)))), b -> b)""",
    ),
    ("json_of", "t STRING", "VARIANT", r"try_parse_json(regexp_extract(regexp_replace(regexp_replace(regexp_replace(trim(coalesce(t, '')), '^```json\\s*', ''), '^```\\s*', ''), '\\s*```$', ''), '(?s)\\{.*\\}', 0))"),
    ("is_object", "v VARIANT", "BOOLEAN", "coalesce(schema_of_variant(v) LIKE 'OBJECT%', false)"),
    ("field_of", "v VARIANT, path STRING", "STRING", "try_variant_get(v, path, 'string')"),
    (
        "route_reward", "raw STRING, gold_tool STRING", "DOUBLE",
        """get(transform(array(named_struct('v', json_of(raw), 'r', trim(raw))), x -> get(transform(array(coalesce(try_variant_get(x.v, '$.tool_call.name', 'string'), '')), tool -> round(least(greatest(
        CASE WHEN coalesce(schema_of_variant(x.v) LIKE 'OBJECT%', false) THEN 0.08D ELSE -0.45D END + CASE WHEN startswith(x.r, '{') AND endswith(x.r, '}') THEN 0.04D ELSE -0.10D END
        + CASE WHEN coalesce(try_variant_get(x.v, '$.action', 'string') = 'tool_call', false) THEN 0.08D ELSE -0.25D END + CASE WHEN tool <> '' THEN 0.08D ELSE -0.20D END
        + CASE WHEN tool = gold_tool THEN 1.20D WHEN tool <> '' AND split_part(tool, '.', 1) = split_part(gold_tool, '.', 1) THEN 0.25D ELSE -0.15D END
        + CASE WHEN char_length(raw) > 600 THEN -0.20D ELSE 0D END, -1D), 1.5D), 6)), 0)), 0)""",
    ),
)


def register(spark: SparkSession) -> None:
    """The session's temporary functions, in order of use; a second call replaces them."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")


KINDS: dict[str, tuple[type, ...]] = {"string": (str,), "number": (int, float), "boolean": (bool,), "array": (list,), "object": (dict,)}


def checked(schema: dict[str, str], args: object) -> str | None:
    """What is wrong with arguments; a type with a question mark may be missing."""
    if not isinstance(args, dict):
        return "arguments are no object"
    for name, kind in schema.items():
        if args.get(name) is None:
            if not kind.endswith("?"):
                return f"missing argument {name}"
        elif not isinstance(args[name], KINDS[kind.rstrip("?")]) or isinstance(args[name], bool) and kind.rstrip("?") == "number":
            return f"argument {name} is no {kind.rstrip('?')}"
    extra = sorted(set(args) - set(schema))
    return f"unknown argument {extra[0]}" if extra else None


def register_tools(spark: SparkSession, tools: dict[str, tuple[dict[str, str], Callable[[dict], object]]], name: str = "call_tools") -> None:
    """A table function name(TABLE(calls)) over calls (id, tool, args as JSON text) -> (id, tool, result as JSON text, error).

    tools: name -> (argument types, function of the arguments). An unknown tool, bad arguments and a tool's own exception are error rows; null arguments count as
    none. The input's partitions stay as they are: a call is a row, so a popular tool is no hot task.
    """

    @F.udtf(returnType="id: string, tool: string, result: string, error: string")
    class CallTools:
        def eval(self, row: Row) -> Iterator[tuple]:
            call, known = row["id"], tools.get(row["tool"])
            if known is None:
                yield call, row["tool"], None, f"unknown tool {row['tool']}"
                return
            try:
                args = json.loads(row["args"] or "{}")
                wrong = checked(known[0], args)
                result = None if wrong else json.dumps(known[1](args), sort_keys=True, allow_nan=False)
            except Exception as e:  # errors are values: a tool must not end the job
                wrong, result = f"{type(e).__name__}: {e}"[:200], None
            yield call, row["tool"], result, wrong

    spark.udtf.register(name, CallTools)
