"""Queries over one COBOL program for each order, with a paragraph of one sentence for each of its lines, chosen by the
line's part; rules come from specification files that the queries write and scan. The SQL knows what each sentence holds."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.operators import lines, patterns, phrases
from ferrolith.plans.registry import Registry, table
from ferrolith.sources.shared import new_path

registry = Registry()
QUERIES, ORACLE_SQL = registry.queries, registry.sql

#: Sentences and the rules that match in them, once for each time they do.
SENTENCES = [
    ("MOVE A TO B", "move_simple"), ("MOVE CORR R1 TO R2", "move_corresponding"), ("COMPUTE X ROUNDED = A + B", "compute"), ("SET I TO 1", "set_statement"), ("INITIALIZE REC-A", "initialize"),
    ("STRING A INTO B ON OVERFLOW DISPLAY 'MOVE A TO B'", "string_statement on_overflow"), ("UNSTRING A DELIMITED BY ',' INTO B C", "unstring_statement"), ("ADD 1 TO N ON SIZE ERROR DISPLAY 'NOT AT END'", "add_statement on_size_error"),
    ("SUBTRACT A FROM N NOT ON SIZE ERROR DISPLAY 'X'", "subtract_statement on_size_error not_on_size_error"), ("MULTIPLY A BY N", "multiply_statement"), ("DIVIDE A INTO N", "divide_statement"), ("IF A = B DISPLAY 'X'", "if_then"),
    ("IF FS-STATUS NOT = 'Y' PERFORM P-9", "if_then if_perform file_status_check"), ("EVALUATE A WHEN 1 DISPLAY 'X' WHEN OTHER GOBACK END-EVALUATE", "evaluate_when when_clause"), ("PERFORM P-1 UNTIL A > 3", "perform_until"),
    ("PERFORM VARYING I FROM 1 BY 1 UNTIL I > 3 END-PERFORM", "perform_varying perform_until"), ("PERFORM P-1 3 TIMES", "perform_times"), ("PERFORM P-1 THRU P-2", "perform_thru"), ("GO TO P-1", "go_to"), ("GO TO P-1 P-2 DEPENDING ON N", "go_to go_to_depending"),
    ("CALL 'X' ON EXCEPTION DISPLAY 'Y'", "on_exception"), ("CALL 'X' NOT ON EXCEPTION DISPLAY 'Y'", "on_exception not_on_exception"), ("READ F1 AT END DISPLAY 'Y' NOT AT END DISPLAY 'Z' END-READ", "at_end at_end not_at_end"),
    ("WRITE R1 INVALID KEY DISPLAY 'Y'", "invalid_key"), ("READ F1 NOT INVALID KEY DISPLAY 'Y'", "invalid_key not_invalid_key"), ("IF SQLCODE < 0 DISPLAY 'Y'", "if_then sqlcode_check"), ("IF EIBRESP EQUAL 0 GOBACK", "if_then resp_check"),
    ("DISPLAY 'PERFORM X UNTIL Y'", ""),
]

REQUIRED = ["move_simple", "go_to"]
CATEGORY = {name: c for c, named in phrases.COBOL_PHRASES.items() for name in named}


def _source(spark, d) -> DataFrame:
    """(file_id, line_no, text)."""
    within = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    sentence = F.get(F.array(*[F.lit(t) for t, _ in SENTENCES]), (F.col("l_partkey") % len(SENTENCES)).cast("int"))
    rows = lines.dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", 50000)
    numbered = rows.select(F.col("l_orderkey").alias("file_id"), F.row_number().over(within).alias("n"), sentence.alias("t"))
    line = lambda at, *parts: F.struct(at.cast("bigint").alias("line_no"), F.concat(*parts).alias("text"))
    own = [line(2 * F.col("n"), F.lit("       P-"), F.col("n").cast("string"), F.lit(".")), line(2 * F.col("n") + 1, F.lit("           "), F.col("t"), F.lit("."))]
    first = line(F.lit(1), F.lit("       PROCEDURE DIVISION."))
    return numbered.select("file_id", F.inline(F.when(F.col("n") == 1, F.array(first, *own)).otherwise(F.array(*own))))


def _specifications(spark) -> tuple[DataFrame, DataFrame]:
    """The scan of two folders of specification files, of which the first goes before the second."""
    roots = [new_path(spark, "own-rules"), new_path(spark, "cached-rules")]
    cobol = phrases.specification("cobol", phrases.COBOL_PHRASES, ["cbl", "COB"], REQUIRED)
    held = [[cobol], [phrases.specification("cobol", {"old": {"old": "OLD"}}), phrases.specification("plain", {"jumps": {"go_to": "GO TO @"}}, ["txt"]), {"spec_id": "broken"}]]
    for root, specs in zip(roots, held):
        for spec in specs:
            spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.mode("append").text(root)
    return phrases.scan_specifications(spark, roots, "*.txt")


def _rules(spark) -> list[patterns.Rule]:
    return phrases.rules_of(_specifications(spark)[0], "cobol")


FACTS = f"""facts(k, category, name) AS (VALUES {", ".join(f"({k}, '{CATEGORY[name]}', '{name}')" for k, (_, names) in enumerate(SENTENCES) for name in names.split())}),
m AS (SELECT l_orderkey AS file_id, n, category, name FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) JOIN facts ON k = l_partkey % {len(SENTENCES)})"""


@registry.add(f"WITH {FACTS} SELECT file_id, 'P-' || n AS paragraph, 2 * n + 1 AS line_no, category, name FROM m")
def cobol_phrase_matches(spark, d):
    return phrases.phrase_matches(_source(spark, d), _rules(spark)).drop("found")


@registry.add(f"""WITH {FACTS}, sizes(category, total) AS (VALUES {", ".join(f"('{c}', {len(named)})" for c, named in phrases.COBOL_PHRASES.items())})
SELECT file_id, m.category, count(*) AS n_matches, count(DISTINCT name) AS n_rules, round(100.0 * count(DISTINCT name) / any_value(total), 2) AS coverage FROM m JOIN sizes USING (category) GROUP BY file_id, m.category""")
def cobol_phrase_coverage(spark, d):
    rules = _rules(spark)
    return patterns.coverage_of(phrases.phrase_counts(_source(spark, d), rules), rules, "file_id")


@registry.add(f"""WITH {FACTS}, wanted(category, name) AS (VALUES {", ".join(f"('{CATEGORY[n]}', '{n}')" for n in REQUIRED)})
SELECT o.file_id, w.category, w.name FROM (SELECT DISTINCT l_orderkey AS file_id FROM lineitem) o, wanted w WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.file_id = o.file_id AND m.name = w.name)""")
def cobol_required_phrases(spark, d):
    rules = [r for r in _rules(spark) if r.required]
    return patterns.required_without_count(phrases.phrase_counts(_source(spark, d), rules), rules, "file_id")
