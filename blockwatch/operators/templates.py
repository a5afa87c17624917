"""Message templates as a Spark job.

Mining rule (deterministic and independent of line order):
  1. mask variables (IP addresses) with '<*>';
  2. split on whitespace;
  3. every token containing a digit becomes '<*>';
  4. group lines on (token count, first token, second token);
  5. inside a group, a token position is *kept* when it has one distinct value;
  6. if kept / token count >= st, the group is one template (other positions '<*>');
  7. otherwise the group is split by its tokens at the position of the fewest values over one (the
     leftmost of equal ones), and 5-7 hold for each part, in at most ``rounds`` rounds;
  8. what is left then is its own template, line by line.

Work is done on distinct masked lines, so repeated messages (the bulk of any log) cost one row each.
A round deals the open lines out by group once; tokens are taken apart, counted and joined back inside
those partitions, so no token is shuffled. Groups of more tokens than a partition should hold are few:
their tokens are counted by (group, position, token) in all partitions and their results broadcast.
Groups and lines are named by 128 bits of SHA-256. Groups that have their template leave the loop,
which ends when none is open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwatch.functions.parsing import MASK_TOKEN, mask_variables
from blockwatch.functions.text import WHITESPACE
from blockwatch.operators.position import with_position
from blockwatch.session import written

DEFAULT_ST = 0.8
DEFAULT_DEPTH = 4  # tree depth 4 -> depth - 2 = 2 leading tokens in the group key
DEFAULT_ROUNDS = 6  # the first grouping and up to five splits
# Tokens that a partition of a round holds, about; a larger group is counted in all partitions.
PART_TOKENS = 1 << 19


# A token (maximal run of non-whitespace) that contains a digit.
DIGIT_TOKEN = r"[^ \t\n\r\f]*[0-9][^ \t\n\r\f]*"


def masked_tokens(content_col: str) -> F.Column:
    """Steps 1-3: IP masks, then every digit-bearing token -> '<*>', then whitespace split."""
    masked = F.regexp_replace(mask_variables(content_col), DIGIT_TOKEN, MASK_TOKEN)
    return F.array_remove(F.split(masked, WHITESPACE), "")


def _digest(*parts: F.Column) -> F.Column:
    """128 bits of the SHA-256 of the parts: a short name of a group or line, however long its text."""
    return F.unhex(F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 32))


def _group_key(n_lead: int) -> F.Column:
    parts = [F.size("_bw_toks").cast("string")]
    for i in range(n_lead):
        parts.append(F.coalesce(F.get(F.col("_bw_toks"), i), F.lit("")))
    return _digest(*parts)


def _tokens() -> F.Column:
    """The tokens of a masked line: they hold no blanks."""
    return F.split("_bw_m", " ", -1)


def _group_facts(lines: DataFrame, st: float) -> DataFrame:
    """_bw_g, _bw_split (NULL for a group that is one template, else the position to split it by) and
    _bw_varied (the positions of more than one value) of the groups of ``lines`` (_bw_m, _bw_g)."""
    positions = (lines.select("_bw_g", F.posexplode(_tokens()).alias("_bw_i", "_bw_t")).distinct()
                 .groupBy("_bw_g", "_bw_i").agg(F.count(F.lit(1)).alias("_bw_nd")))
    varied = F.col("_bw_nd") > 1
    groups = positions.groupBy("_bw_g").agg(
        (F.count_if(~varied) / F.count(F.lit(1))).alias("_bw_kept"),
        # Fewest values, then leftmost, as one number.
        F.min(F.when(varied, F.shiftleft("_bw_nd", 24) + F.col("_bw_i"))).alias("_bw_least"),
        F.collect_list(F.when(varied, F.col("_bw_i"))).alias("_bw_varied"))
    done = F.col("_bw_kept") >= F.lit(float(st))
    return groups.select("_bw_g", F.when(~done, F.col("_bw_least").bitwiseAND((1 << 24) - 1).cast("int")).alias("_bw_split"),
                         F.when(done, F.col("_bw_varied")).alias("_bw_varied"))


def _with_facts(opened: DataFrame, st: float) -> DataFrame:
    """``opened`` (_bw_m, _bw_g) with the facts of each line's group."""
    sizes = opened.groupBy("_bw_g").agg(F.sum(F.size(_tokens())).alias("_bw_n"))
    total, most = sizes.agg(F.sum("_bw_n"), F.max("_bw_n")).first()
    parts = (total or 0) // PART_TOKENS + 1
    if (most or 0) <= PART_TOKENS:
        own = opened.repartition(parts, "_bw_g")
        return own.join(_group_facts(own, st).hint("merge"), "_bw_g")
    # At most total / PART_TOKENS groups.
    large = F.broadcast(written(sizes.where(F.col("_bw_n") > PART_TOKENS).select("_bw_g"), "large-groups"))
    own = opened.join(large, "_bw_g", "left_anti").repartition(parts, "_bw_g")
    spread = opened.join(large, "_bw_g", "left_semi")
    facts = F.broadcast(written(_group_facts(spread, st), "large-facts"))
    return own.join(_group_facts(own, st).hint("merge"), "_bw_g").unionByName(spread.join(facts, "_bw_g"))


def masked_line_templates(masked: DataFrame, st: float = DEFAULT_ST, depth: int = DEFAULT_DEPTH,
                          rounds: int = DEFAULT_ROUNDS) -> DataFrame:
    """_bw_h (``_digest`` of a masked line), _bw_tpl: the template of every distinct line in ``masked``
    (_bw_m, _bw_toks) that has tokens."""
    found: list[DataFrame] = []
    opened = written(masked.where(F.size("_bw_toks") > 0).select("_bw_m", _group_key(max(depth - 2, 0)).alias("_bw_g")).distinct(),
                     "masked-lines", "zstd")
    left = "_bw_tpl IS NULL"
    template = F.array_join(F.transform(_tokens(), lambda t, i: F.when(F.array_contains("_bw_varied", i), F.lit(MASK_TOKEN)).otherwise(t)), " ")
    for k in range(rounds):
        last = k == rounds - 1
        done = F.col("_bw_split").isNull()
        # The next round's group: the split position and the line's token there. After the last round an
        # open line is its own template.
        part = _digest(F.hex("_bw_g"), F.col("_bw_split").cast("string"), F.get(_tokens(), F.col("_bw_split")))
        step = written(_with_facts(opened, st).select(
            F.when(~done, F.col("_bw_m")).alias("_bw_m"), F.when(~done, part).alias("_bw_g"),
            F.when(done | F.lit(last), _digest(F.col("_bw_m"))).alias("_bw_h"),
            F.when(done, template).when(F.lit(last), F.col("_bw_m")).alias("_bw_tpl")), "template-round", "zstd")
        found.append(step.where(f"NOT ({left})").select("_bw_h", "_bw_tpl"))
        opened = step.where(left).select("_bw_m", "_bw_g")
        if last or opened.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def mine_templates(lines: DataFrame, content_col: str = "content", st: float = DEFAULT_ST,
                   depth: int = DEFAULT_DEPTH, out_col: str = "template", rounds: int = DEFAULT_ROUNDS) -> DataFrame:
    """Add ``template`` to every line.

    Masking and tokenising are plain expressions in the scan stage. Lines meet their templates through
    a table with one row for each distinct masked line, which is broadcast when it is small.
    """
    # Both branches tokenise: a second regex pass costs less than keeping all lines twice. Lines go to
    # the dictionary by their digests; what has no tokens is not in it.
    tok = lines.withColumn("_bw_toks", masked_tokens(content_col)).withColumn("_bw_m", F.array_join("_bw_toks", " "))
    dictionary = masked_line_templates(tok.select("_bw_m", "_bw_toks"), st, depth, rounds)
    own = (tok.withColumn("_bw_h", _digest(F.col("_bw_m"))).withColumn("_bw_none", F.when(F.size("_bw_toks") == 0, F.lit("")))
           .drop("_bw_toks", "_bw_m"))
    out = own.join(dictionary, "_bw_h", "left")
    return out.withColumn(out_col, F.coalesce("_bw_tpl", "_bw_none")).drop("_bw_h", "_bw_none", "_bw_tpl")


def event_id(template_col: str = "template") -> F.Column:
    """Stable template id: first 8 hex digits of md5(template)."""
    return F.substring(F.md5(F.col(template_col)), 1, 8)


def template_dictionary(mined: DataFrame, template_col: str = "template") -> DataFrame:
    """One row per template with its occurrence count."""
    return (mined.groupBy(template_col).agg(F.count(F.lit(1)).alias("occurrences"))
            .withColumn("event_id", event_id(template_col)))


def number_templates(dictionary: DataFrame, template_col: str = "template",
                     id_col: str = "template_id") -> DataFrame:
    """L8: 'E1'..'En' by (occurrences desc, template asc)."""
    # Numbering reads its input several times, and the numbers are joined to lines: both are written.
    ranked = with_position(written(dictionary.withColumn("_bw_neg", -F.col("occurrences")), "dictionary"),
                           ["_bw_neg", template_col], name="_bw_r")
    return written(ranked.withColumn(id_col, F.concat(F.lit("E"), (F.col("_bw_r") + 1).cast("string")))
            .drop("_bw_neg", "_bw_r"), "template-ids")


def first_per_key(df: DataFrame, key_col: str, value_col: str, order_col: str) -> DataFrame:
    """The value of the first row per key (by ``order_col``) as a lookup table."""
    return df.groupBy(key_col).agg(F.min_by(value_col, order_col).alias(value_col))


def lookup_join(lines: DataFrame, lookup: DataFrame, key_col: str) -> DataFrame:
    """Left join to a lookup table; unmatched keys get NULL. The lookup is
    dictionary-sized; AQE broadcasts it when its measured size is small."""
    return lines.join(lookup, key_col, "left")
