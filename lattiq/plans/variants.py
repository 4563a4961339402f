"""The catalogue of algorithm variants and the language that selects from it.

A template is annotated text; each line that holds ``/*@Tag@*/`` marks offers a choice between its marks, known by the
first of them.  A variant takes one choice per line.  It is buggy if some chosen mark names a planted bug (``...Bug``) that is not
negated (``No...Bug``).

Lines between ``/*@+Tag@*/`` and ``/*@-Tag@*/`` form a section, which a variant contains only if it chose all tags named at its start, or
one of them where ``or`` is named too.  Sections do not nest further.  A chosen piece of code that says ``declare`` only offers its mark
and writes nothing; one that says ``suppress`` discards the variant.  So is a variant discarded one of whose tags is never used: neither names a
section it contains nor has code of its own there.

Filters: bugs ``nobug`` / ``hasbug`` / ``all``; options, data types and patterns are lists of ``all``, ``x`` (offered), ``~x``
(excluded) and ``only_x`` (required).  Variants without a data type pass only where ``int`` is asked for.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = re.compile(r"/\*@([A-Za-z]*[0-9]*)@\*/")
#: Data type marks, and names of traversals in template names.
DATA_TYPES = ("inttype", "longtype", "floattype", "doubletype")
TRAVERSALS = {"V": "vertex", "E": "edge"}
SECTION = re.compile(r"/\*@([+-])([A-Za-z]*[0-9]*)@\*/")
#: Words of the language.
DECLARE, SUPPRESS, EITHER = "declare", "suppress", "or"
BLANK, BLANK_IN_SECTION = "//BlankLine", "//+BlankLine"
LINE = "struct<named:array<string>,either:boolean,opens:boolean,first:boolean,blank:boolean,marks:array<string>,codes:array<string>>"
SCHEMA = f"template string, algorithm string, model string, style array<string>, choices array<array<string>>, body array<{LINE}>"


def choices_of(text: str) -> list[list[str]]:
    """The choices of a template in order of their first line."""
    found: dict[str, list[str]] = {}
    for line in text.splitlines():
        marks = MARK.findall(line)
        if marks:
            found.setdefault(marks[0], marks)
    return list(found.values())


def body_of(text: str) -> list[tuple]:
    """The lines of a template as rows of LINE: the tags of the section around each, and its marks with their code (one unmarked piece
    for a plain line).  A section's start is a row without code; ``first`` is the row after it."""
    rows, named, either, first = [], [], False, False
    for line in map(str.strip, text.splitlines()):
        signs = SECTION.findall(line)
        if signs and signs[0][0] == "-":
            named, either, first = [], False, False
        elif signs:
            if named:
                raise ValueError(f"section within a section: {line}")
            names = [name for _, name in signs]
            named, either, first = [n for n in names if n != EITHER], EITHER in names, True
            rows.append((named, either, True, False, False, [], []))
        elif line == BLANK or (named and line == BLANK_IN_SECTION):
            rows.append(([] if line == BLANK else named, either, False, False, True, [], [""]))
        else:
            pieces = MARK.split(line)
            marks, codes = pieces[1::2], [p.strip() for p in pieces[2::2]]
            rows.append((named, either, False, first, False, marks, codes if marks else [line]))
            first = False
    return rows


def templates(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """A row per template from {name: annotated text}; names are ALG_MODEL_traversal_driver[_flow]."""
    rows = []
    for name, text in texts.items():
        algorithm, model, *style = name.split("_")
        rows.append((name, algorithm.lower(), model.lower(), [TRAVERSALS.get(s, s.lower()) for s in style], choices_of(text), body_of(text)))
    return spark.createDataFrame(rows, SCHEMA)


def expand(catalogue: DataFrame) -> DataFrame:
    """(template, algorithm, model, style, body, tags, buggy): one row per combination of choices."""
    grown = F.aggregate(
        "choices",
        F.array(F.array().cast("array<string>")),
        lambda done, group: F.flatten(F.transform(done, lambda d: F.transform(group, lambda tag: F.concat(d, F.array(tag))))),
    )
    rows = catalogue.select("template", "algorithm", "model", "style", "body", F.explode(grown).alias("tags"))
    tags = F.filter("tags", lambda t: t != "")
    bug = lambda t: t.rlike("Bug[0-9]*$") & ~t.rlike("^No")
    return rows.withColumn("tags", tags).withColumn("buggy", F.exists("tags", bug))


def _faulty(tag: Column, code: Column) -> Column:
    """Whether a piece of code gets a label: its tag names a bug or race that is not negated, and there is code (a race: without an atomic)."""
    tag, code = F.lower(tag), F.lower(code)
    race = tag.contains("race") & ~code.contains("atomic")
    return (race | tag.contains("bug")) & ~tag.contains("no") & (code != "")


def _labelled(code: Column, tags: Column, depth: Column) -> Column:
    """``code`` after a comment line for each of ``tags`` that is faulty."""
    return F.aggregate(tags, code, lambda done, t: F.when(_faulty(t, done), F.concat(F.lit("// "), t, F.lit(" here\n"), F.repeat(F.lit(" "), depth), done)).otherwise(done))


def written(variants: DataFrame) -> DataFrame:
    """``variants`` of ``expand`` that the template allows, with the text of each as ``code`` instead of ``body``; a line is
    indented by two for each brace open before it.  A comment names the planted bug before code that a tag of one chose, and before the first
    line of a section that stands there because of it."""
    tags = F.col("tags")
    inside = F.filter(
        "body", lambda x: (F.size(x.named) == 0) | F.when(x.either, F.arrays_overlap(x.named, tags)).otherwise(F.size(F.array_except(x.named, tags)) == 0)
    )
    chosen = lambda x: F.get(F.array_intersect(x.marks, tags), F.lit(0))
    picked = lambda x: F.when(F.size(x.marks) == 0, F.get(x.codes, F.lit(0))).otherwise(F.get(x.codes, (F.array_position(x.marks, chosen(x)) - 1).cast("int")))
    piece = lambda x: F.struct(x.opens.alias("opens"), x.first.alias("first"), x.blank.alias("blank"), F.array_intersect(x.named, tags).alias("named"), chosen(x).alias("tag"), F.coalesce(picked(x), F.lit("")).alias("code"))
    rows = variants.withColumn("lines", F.transform(inside, piece))
    own = F.filter("lines", lambda x: x.tag.isNotNull())
    starts = F.flatten(F.transform(F.filter("lines", lambda x: x.opens), lambda x: x.named))
    used = F.concat(starts, F.transform(F.filter(own, lambda x: ~x.code.contains(DECLARE)), lambda x: x.tag))
    rows = rows.where(~F.exists(own, lambda x: x.code.contains(SUPPRESS))).where(F.size(F.array_except("tags", used)) == 0)

    def add(done: Column, x: Column) -> Column:
        tag = F.when(x.tag.isNull(), F.array().cast("array<string>")).otherwise(F.array(x.tag))
        code = _labelled(x.code, F.when(x.first, F.concat(tag, x.named)).otherwise(tag), done.depth)
        depth = done.depth - F.when(code.startswith("}"), 2).otherwise(0)
        line = F.when(x.blank, F.lit("\n")).when((code == "") | code.contains(DECLARE), F.lit("")).otherwise(F.concat(F.repeat(F.lit(" "), depth), code, F.lit("\n")))
        return F.struct(F.concat(done.text, line).alias("text"), (depth + F.when(code.endswith("{"), 2).otherwise(0)).alias("depth"))

    code = F.aggregate(F.filter("lines", lambda x: ~x.opens), F.struct(F.lit("").alias("text"), F.lit(0).alias("depth")), add, lambda done: done.text)
    return rows.withColumn("code", code).drop("body", "lines")


def suppressed(variants: DataFrame, forbidden: DataFrame) -> DataFrame:
    """``variants`` without those that hold all tags of a row of ``forbidden(template, tags)``."""
    rule = forbidden.select(F.col("template").alias("f_template"), F.col("tags").alias("f_tags"))
    hit = (F.col("template") == F.col("f_template")) & (F.size(F.array_except("f_tags", "tags")) == 0)
    return variants.join(F.broadcast(rule), hit, "left_anti")


def _passes(names: Column, terms: list[str]) -> Column:
    terms = [t.lower() for t in terms]
    ok = F.lit("all" in terms or any(t.startswith("only_") for t in terms))
    for t in terms:
        if t != "all" and t[0] != "~" and not t.startswith("only_"):
            ok = ok | F.array_contains(names, t.removeprefix("all_"))
    for t in terms:
        if t[0] == "~":
            ok = ok & ~F.array_contains(names, t[1:])
        elif t.startswith("only_"):
            ok = ok & F.array_contains(names, t.removeprefix("only_"))
    return ok


def select(variants: DataFrame, bug: list[str], pattern: list[str], option: list[str], data_type: list[str]) -> DataFrame:
    """The variants that the four lists select."""
    low = F.transform("tags", lambda t: F.lower(t))
    types = F.filter(low, lambda t: t.isin(*DATA_TYPES))
    options = F.concat("style", F.filter(low, lambda t: ~t.isin(*DATA_TYPES)))
    kinds = set(bug)
    if not kinds or not kinds <= {"nobug", "hasbug", "all"}:
        raise ValueError("bug takes nobug, hasbug or all")
    out = variants if "all" in kinds or len(kinds) > 1 else variants.where(F.col("buggy") == ("hasbug" in kinds))
    untyped = F.lit("int" in [t.lower() for t in data_type])
    out = out.where(_passes(F.array("algorithm"), pattern)).where(_passes(options, option))
    return out.where(F.when(F.size(types) == 0, untyped).otherwise(_passes(types, data_type)))


def read_configuration(text: str) -> dict[str, list[str]]:
    """The four lists of a configuration text; a leading comment is skipped."""
    body = text.rpartition("**/")[2]
    found = {k: re.findall(r"[~\w]+", v) for k, v in re.findall(r"(\w+)\s*:\s*\{([^}]*)\}", body)}
    missing = {"bug", "pattern", "option", "dataType"} - set(found)
    if missing:
        raise ValueError(f"configuration lacks {sorted(missing)}")
    return found


def summary(variants: DataFrame) -> DataFrame:
    return variants.agg(F.count(F.lit(1)).alias("codes"), F.count_if("buggy").alias("buggy_codes"))


#: A template of our own for the registered query.
EXAMPLE = {
    "BFS_OMP_V_Data_Push": "/*@IntType@*/ int /*@LongType@*/ long\n/*@NonDup@*/ a /*@Dup@*/ b\n/*@NoRaceBug@*/ x /*@RaceBug@*/ y\n",
    "CC_C_E_Topo": "/*@IntType@*/ int /*@LongType@*/ long\n/*@Block@*/ a /*@Cyclic@*/ b\n/*@NoBoundsBug@*/ x /*@BoundsBug@*/ y\n",
}


def example(spark: SparkSession) -> DataFrame:
    chosen = select(expand(templates(spark, EXAMPLE)), ["nobug"], ["all"], ["all", "~dup"], ["IntType"])
    return chosen.select("template", F.array_join("tags", "_").alias("tags"), "buggy")


EXAMPLE_SQL = """with v(template, a, b, c) as (
  select 'BFS_OMP_V_Data_Push', a, b, c from (values ('IntType'), ('LongType')) x(a), (values ('NonDup'), ('Dup')) y(b), (values ('NoRaceBug'), ('RaceBug')) z(c)
  union all
  select 'CC_C_E_Topo', a, b, c from (values ('IntType'), ('LongType')) x(a), (values ('Block'), ('Cyclic')) y(b), (values ('NoBoundsBug'), ('BoundsBug')) z(c))
select template, concat_ws('_', a, b, c) as tags, false as buggy from v where c like 'No%' and b <> 'Dup' and a = 'IntType'"""


#: A template of our own with sections, offers without code and a suppressed choice.
SECTIONS = {
    "MIS_OMP_V_Topo": """/*@Calm@*/ declare /*@Eager@*/ declare
/*@NoFieldBug@*/ declare /*@FieldBug@*/ declare
/*@Low@*/ low(); /*@High@*/ high(); /*@Top@*/ suppress
run() {
/*@+Calm@*/
calm();
/*@-Calm@*/
/*@+Eager@*/
/*@Low@*/ suppress /*@High@*/ eager();
/*@-Eager@*/
/*@+NoFieldBug@*/
all();
/*@-NoFieldBug@*/
/*@+FieldBug@*/
few();
/*@-FieldBug@*/
//BlankLine
/*@+or@*/ /*@+FieldBug@*/ /*@+Eager@*/
}
/*@-or@*/
"""
}


def sections_example(spark: SparkSession) -> DataFrame:
    chosen = written(expand(templates(spark, SECTIONS)))
    return chosen.select("template", F.array_join("tags", "_").alias("tags"), "buggy", "code")


SECTIONS_SQL = """with v(a, b, c) as (
  select a, b, c from (values ('Calm'), ('Eager')) x(a), (values ('NoFieldBug'), ('FieldBug')) y(b), (values ('Low'), ('High'), ('Top')) z(c))
select 'MIS_OMP_V_Topo' as template, concat_ws('_', a, b, c) as tags, b = 'FieldBug' as buggy,
  lower(c) || '();' || chr(10) || 'run() {' || chr(10) || '  ' || lower(a) || '();' || chr(10)
  || case b when 'FieldBug' then '  // FieldBug here' || chr(10) || '  few();' else '  all();' end || chr(10) || chr(10)
  || case when b = 'FieldBug' or a = 'Eager' then case b when 'FieldBug' then '  // FieldBug here' || chr(10) || '  }' else '}' end || chr(10) else '' end as code
from v where c <> 'Top' and not (a = 'Eager' and c = 'Low')"""
