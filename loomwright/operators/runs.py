"""Run records, messages, rules and routes."""

from __future__ import annotations

import ast
import functools
import json
import operator
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def costs_by_stage(calls: DataFrame) -> DataFrame:
    """calls (stage, seq, model, prompt_tokens, completion_tokens, cost): sums by stage, the model first seen."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return calls.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.min_by("model", "seq").alias("model"), total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"))


def running_budget(steps: DataFrame, most: int) -> DataFrame:
    """steps (run_id, step, tokens): tokens used so far, what remains, whether the budget is spent, and whether to warn."""
    used = F.sum("tokens").over(Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    d = steps.withColumn("used", used).withColumn("remaining", F.greatest(F.lit(0), F.lit(most) - F.col("used")).cast("bigint"))
    return d.withColumn("exceeded", F.col("used") >= most).withColumn("warn", F.col("remaining") < 0.15 * most)


def doom_loops(calls: DataFrame, n: int = 3) -> DataFrame:
    """calls (run_id, seq, call): whether each is the same as the n - 1 before it."""
    w = Window.partitionBy("run_id").orderBy("seq")
    same = F.lit(True)
    for i in range(1, n):
        same = same & F.coalesce(F.lag("call", i).over(w) == F.col("call"), F.lit(False))
    return calls.withColumn("loop", same)


def token_estimate(messages: DataFrame) -> DataFrame:
    """Characters of all messages of a conversation, by 4."""
    return messages.groupBy("conv_id").agg(F.floor(F.coalesce(F.sum(F.length("text")), F.lit(0)) / 4).cast("bigint").alias("tokens"))


def prune(messages: DataFrame, role: str, keep: int, note: str) -> DataFrame:
    """Bodies of `role` before the keep-th last user turn replaced; with so few user turns or fewer, all of them."""
    after = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy("conv_id"))
    old = (F.col("role") == role) & ((after >= keep) | (total <= keep))
    return messages.withColumn("text", F.when(old, note).otherwise(F.col("text")))


def suffix_fit(messages: DataFrame, budget: int) -> DataFrame:
    """The newest messages of a conversation whose characters fit."""
    run = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("run", run).where(F.col("run") <= budget).drop("run")


def water_fill(messages: DataFrame, budget: int) -> DataFrame:
    """The greatest cap of each conversation with which the capped lengths fit: prefix sums over sorted lengths."""
    w = Window.partitionBy("conv_id").orderBy("len", "turn")
    d = messages.withColumn("len", F.length("text").cast("bigint"))
    d = d.withColumn("below", F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("left", F.count(F.lit(1)).over(w.rowsBetween(0, Window.unboundedFollowing)))
    d = d.withColumn("cap", F.floor((F.lit(budget) - F.col("below")) / F.col("left")).cast("bigint"))
    fit = F.min(F.when(F.col("len") > F.col("cap"), F.struct("len", "turn", "cap")))["cap"]
    return d.groupBy("conv_id").agg(F.greatest(F.lit(0), F.coalesce(fit, F.max("len"))).cast("bigint").alias("cap"))


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of a conversation that aren't the system's."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.where("role <> 'system'").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def drop_orphans(results: DataFrame, calls: DataFrame) -> DataFrame:
    """Tool results whose call is still there."""
    return results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_semi")


# The grammar of rules, the longest pattern and the length of text that MATCHES looks at.
_RULE = re.compile(r"^(\w+)\s+(NOT\s+)?(CONTAINS|STARTS_WITH|MATCHES|IN)\s+(.+)$")
PATTERN_CHARS, MATCHED_CHARS = 500, 10_000


def rule_problem(condition: object) -> str | None:
    """Why a condition can never hold, or None: to be asked before a rule is stored, since a bad one matches nothing."""
    if not isinstance(condition, str) or not condition.strip():
        return "a condition is a text that isn't empty"
    m = _RULE.match(condition.strip())
    if not m:
        return f"{condition!r} isn't of the form: field [NOT] CONTAINS|STARTS_WITH|MATCHES|IN value"
    op, value = m[3], m[4].strip()
    if op == "IN" and not isinstance(_listed(value), list):
        return "IN takes a JSON list"
    if op == "MATCHES":
        pattern = value.strip("'\"")
        if len(pattern) > PATTERN_CHARS:
            return f"a pattern has {PATTERN_CHARS} characters at most"
        try:
            re.compile(pattern, re.DOTALL)
        except re.error as e:
            return f"no regular expression: {e}"
    return None


def _listed(value: str) -> object:
    """The JSON value of a list that may be quoted either way; None for no JSON."""
    try:
        return json.loads(value.replace("'", '"'))
    except json.JSONDecodeError:
        return None


def rule(condition: str, columns: Sequence[str], kinds: dict[str, str] | None = None) -> Column:
    """`field [NOT] CONTAINS|STARTS_WITH|MATCHES|IN value` as a predicate that is never null.

    A missing field is empty text and a null reads None. A bad pattern or list matches nothing, so that its negation
    holds; what has no such form is false. kinds: types of the columns; truth values then read True and False.
    """
    m = _RULE.match(condition.strip())
    if not m:
        return F.lit(False)
    name, negated, op, value = m[1], bool(m[2]), m[3], m[4].strip()
    field = F.lit("")
    if name in columns:
        text = F.col(f"`{name}`").cast("string")
        field = F.coalesce(F.initcap(text) if (kinds or {}).get(name) == "boolean" else text, F.lit("None"))
    out = F.lit(False)
    if op == "IN":
        listed = _listed(value)
        if isinstance(listed, str):
            out = F.lit(listed).contains(field)
        elif isinstance(listed, list | dict) and (texts := [x for x in listed if isinstance(x, str)]):
            out = field.isin(texts)
    else:
        value = value.strip("'\"")
        if op != "MATCHES":
            out = field.contains(value) if op == "CONTAINS" else field.startswith(value)
        elif rule_problem(condition) is None:
            out = F.left(field, F.lit(MATCHED_CHARS)).rlike(f"(?s){value}")
    return ~out if negated else out


def apply_rules(rows: DataFrame, rules: list[tuple[str, ...]]) -> DataFrame:
    """rows with allowed and reason: the first rule (condition, message, action) that matches and denies.

    The action is deny where there is none; rules of other actions are passed over.
    """
    reason, kinds = F.lit(None).cast("string"), dict(rows.dtypes)
    for condition, message, *action in reversed(rules):
        if (action or ["deny"])[0] == "deny":
            reason = F.when(rule(condition, rows.columns, kinds), message).otherwise(reason)
    return rows.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
_OPS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Mod: lambda a, b: a - b * F.floor(F.try_divide(a, b))}
_ORDER = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
_CMP = _ORDER | {ast.Eq: lambda a, b: a.eqNullSafe(b), ast.NotEq: lambda a, b: ~a.eqNullSafe(b)}


class _Coerced:
    """An operand of a comparison: what reads as true, false, a whole number or a decimal is a number, all else text."""

    def __init__(self, c: Column):
        self.text = c.cast("string")
        word = F.lower(F.regexp_replace(self.text, r"^\s+|\s+$", ""))
        plain = F.replace(word, F.lit("_"), F.lit(""))
        whole = F.when(word.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), plain)
        decimal = F.when(word.rlike(r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?$"), plain)
        special = F.when(word.rlike(r"^[+-]?(inf|infinity)$"), F.when(word.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        self.whole = F.coalesce(whole.try_cast("bigint"), F.when(word == "true", 1).when(word == "false", 0).cast("bigint"))
        self.number = F.coalesce(self.whole.cast("double"), decimal.try_cast("double"), special)
        self.nan = word.rlike(r"^[+-]?nan$")


def _compare(op: type, a: Column, b: Column) -> Column:
    """a op b for operands of any type. Order between text and number, or with null, is null; equality is then false."""
    x, y = _Coerced(a), _Coerced(b)
    numbers, texts = x.number.isNotNull() & y.number.isNotNull(), x.number.isNull() & y.number.isNull()
    f = _CMP[op]
    both = F.when(x.whole.isNotNull() & y.whole.isNotNull(), f(x.whole, y.whole)).otherwise(f(x.number, y.number))
    if op in _ORDER:
        nan = F.coalesce(x.nan, F.lit(False)) | F.coalesce(y.nan, F.lit(False))
        return F.when(numbers, both).when(nan, F.lit(False)).when(texts, f(x.text, y.text))
    nan = F.coalesce(x.nan | y.nan, F.lit(False))
    same = F.when(numbers, both).when(texts & ~nan, f(x.text, y.text))
    return F.coalesce(same, F.lit(op is ast.NotEq))


def compile_expression(source: str, columns: Sequence[str], kinds: dict[str, str] | None = None) -> Column:
    """A condition expression as a Column: and/or/not, arithmetic, chained comparisons, names, fields, subscripts, constants.

    Texts that read as numbers or truth values are compared as such. kinds: types of the columns; where both sides are
    known to be numbers, they are compared as they are, so that the filter can be pushed down. Anything else, calls and
    powers among it, raises ValueError. Division by zero, a missing subscript and an order of text and number are null, and
    a null condition is false.
    """

    def numeric(n: ast.AST) -> bool:
        if isinstance(n, ast.Constant):
            return isinstance(n.value, int | float)
        if isinstance(n, ast.Name):
            return (kinds or {}).get(n.id, "").startswith((*_NUMBERS, "decimal"))
        return isinstance(n, ast.BinOp) and numeric(n.left) and numeric(n.right) or isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub) and numeric(n.operand)

    def truth(n: ast.AST) -> Column:
        c = go(n)
        if isinstance(n, ast.Compare | ast.BoolOp) or isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            return F.coalesce(c, F.lit(False))
        text, kind = c.cast("string"), F.typeof(c)
        return F.coalesce(F.when(kind == "string", text != "").when(kind == "boolean", text == "true").when(kind.isin(*_NUMBERS) | kind.startswith("decimal"), text.try_cast("double") != 0).otherwise(~text.isin("", "[]", "{}")), F.lit(False))

    def go(n: ast.AST) -> Column:
        if isinstance(n, ast.Expression):
            return go(n.body)
        if isinstance(n, ast.BoolOp):
            parts = [truth(v) for v in n.values]
            return functools.reduce(operator.and_ if isinstance(n.op, ast.And) else operator.or_, parts)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            return ~truth(n.operand)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -go(n.operand)
        if isinstance(n, ast.BinOp) and type(n.op) in _OPS:
            return _OPS[type(n.op)](go(n.left), go(n.right))
        if isinstance(n, ast.Compare) and all(type(o) in _CMP for o in n.ops):
            sides = [n.left, *n.comparators]
            out = [_CMP[type(o)](go(a), go(b)) if numeric(a) and numeric(b) else _compare(type(o), go(a), go(b)) for o, a, b in zip(n.ops, sides, sides[1:], strict=False)]
            return functools.reduce(operator.and_, out)
        if isinstance(n, ast.Constant) and (n.value is None or isinstance(n.value, str | int | float)):
            return F.lit(n.value)
        if isinstance(n, ast.Name) and n.id in columns:
            return F.col(f"`{n.id}`")
        if isinstance(n, ast.Attribute):
            return go(n.value)[n.attr]
        if isinstance(n, ast.Subscript):
            at = n.slice.operand if (back := isinstance(n.slice, ast.UnaryOp) and isinstance(n.slice.op, ast.USub)) else n.slice
            if isinstance(at, ast.Constant) and isinstance(at.value, str) and not back:
                return go(n.value)[at.value]
            if isinstance(at, ast.Constant) and type(at.value) is int:
                return F.try_element_at(go(n.value), F.lit(-at.value)) if back else F.get(go(n.value), F.lit(at.value))
        raise ValueError(f"not allowed in an expression: {ast.dump(n)[:60]}")

    tree = ast.parse(source, mode="eval")
    return truth(tree.body)


def route(rows: DataFrame, branches: list[str]) -> DataFrame:
    """rows with the route of the first branch that holds: if, elif_1, ..., else."""
    out, kinds = F.lit("else"), dict(rows.dtypes)
    for i, b in reversed(list(enumerate(branches))):
        out = F.when(compile_expression(b, rows.columns, kinds), f"elif_{i}" if i else "if").otherwise(out)
    return rows.withColumn("route", out)


# Kinds of errors, by the error's type and by what its message has, in this order.
_TYPES = {"RateLimitError": "rate_limit", "AuthenticationError": "unrecoverable", "PermissionDeniedError": "unrecoverable"}
_MESSAGES = (
    ("prompt_too_long", ("prompt is too long", "context_length_exceeded", "maximum context length", "413", "request too large", "too many tokens")),
    ("max_output_tokens", ("max_tokens", "maximum output", "output token limit")),
    ("unrecoverable", ("invalid api key", "authentication", "unauthorized", "permission denied")),
    ("model_error", ("server error", "500", "502", "503")),
)


def error_class(message: Column, kind: Column | None = None) -> Column:
    """What to do about an error: by its type, else by the first kind whose words the message has, else unrecoverable.

    Null where there is neither a message nor a type.
    """
    kind = F.lit(None).cast("string") if kind is None else kind
    m, out = F.lower(F.coalesce(message, F.lit(""))), F.lit("unrecoverable")
    for name, texts in reversed(_MESSAGES):
        out = F.when(functools.reduce(operator.or_, [m.contains(x) for x in texts]), name).otherwise(out)
    for name, result in _TYPES.items():
        out = F.when(kind == name, result).otherwise(out)
    return F.when(message.isNotNull() | kind.isNotNull(), out)


def finish_class(reason: Column) -> Column:
    """max_output_tokens where an answer ended at its length, else null."""
    return F.when(reason.isin("length", "max_tokens"), "max_output_tokens")


def normalize_messages(messages: DataFrame, tools: Sequence[str] | None = None) -> DataFrame:
    """messages (conv_id, turn, role, content, tool_calls ARRAY<STRUCT<id, name, ...>>, tool_call_id, injected) as a model may get them.

    Injected system messages with a content are wrapped; calls of tools that aren't among `tools` go (null: all stay), and
    a list that is then empty is null; tool results whose call isn't in the conversation go. Calls and results meet by
    conversation and id, so a long conversation isn't gathered.
    """
    wrapped = F.concat(F.lit("<system-context>\n"), F.col("content"), F.lit("\n</system-context>"))
    content = F.when(F.coalesce("injected", F.lit(False)) & (F.col("role") == "system") & (F.col("content") != ""), wrapped).otherwise(F.col("content"))
    calls = F.col("tool_calls")
    if tools is not None:
        left = F.filter(calls, lambda c: F.coalesce(c["name"].isin(*tools), F.lit(False)) if tools else F.lit(False))
        calls = F.when(F.size(left) > 0, left)
    d = messages.withColumns({"content": content, "tool_calls": calls}).drop("injected")
    known = d.select(F.col("conv_id").alias("_c"), F.explode("tool_calls.id").alias("_id")).distinct()
    results = d.where("role = 'tool'").join(known, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("tool_call_id").eqNullSafe(F.col("_id")), "left_semi")
    return d.where("role IS NULL OR role <> 'tool'").unionByName(results)


def fold_stream(chunks: DataFrame) -> DataFrame:
    """chunks (run_id, seq, content, finish_reason): the joined content and the last reason of each run."""
    d = chunks.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("content", F.lit("")).alias("c")))).alias("c"), F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col("seq"))).alias("finish_reason"))
    return d.select("run_id", F.array_join(F.transform("c", lambda x: x["c"]), "").alias("content"), "finish_reason")
