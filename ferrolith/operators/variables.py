"""What paragraphs read and write: operands of statements, resolved against the data items of their program.

A statement's words are folded once: its verb says what the words before and after its keywords do, and OF or IN makes
a word qualify the one before. Names then meet the items by an equi join; words that name no item drop out there.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.operators import cobol, statements

#: For each verb what its first operands do (r reads, w writes, rw both, - neither), and what those after a keyword do.
ROLES = {
    "ACCEPT": ("w", {"FROM": "-"}),
    "ADD": ("r", {"TO": "w", "GIVING": "w"}),
    "COMPUTE": ("w", {"=": "r", "EQUAL": "r"}),
    "DISPLAY": ("r", {"UPON": "-"}),
    "DIVIDE": ("r", {"INTO": "rw", "BY": "r", "GIVING": "w", "REMAINDER": "w"}),
    "EVALUATE": ("r", {}),
    "IF": ("r", {}),
    "INITIALIZE": ("w", {"REPLACING": "r"}),
    "MOVE": ("r", {"TO": "w"}),
    "MULTIPLY": ("r", {"BY": "rw", "GIVING": "w"}),
    "PERFORM": ("-", {"UNTIL": "r", "VARYING": "w", "FROM": "r", "BY": "r"}),
    "READ": ("-", {"INTO": "w"}),
    "SET": ("w", {"TO": "r", "BY": "r"}),
    "STRING": ("r", {"INTO": "w", "POINTER": "rw"}),
    "SUBTRACT": ("r", {"FROM": "rw", "GIVING": "w"}),
    "UNSTRING": ("r", {"INTO": "w", "TALLYING": "rw"}),
    "WHEN": ("r", {}),
    "WRITE": ("w", {"FROM": "r"}),
}

_OUT = "array<struct<name:string,of:array<string>,role:string>>"


def _map(entries: dict[str, str], kind: str) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv]).cast(kind) if entries else F.create_map().cast(kind)


def _bound(value: Column, use) -> Column:
    """use(value), with value bound to a variable of a function, so that it is evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def operands(text: Column) -> Column:
    """An array of (name, of, role) over the words of a statement, upper case, without literals; of: its qualifiers.
    With GIVING, only what follows that is written."""
    plain = F.regexp_replace(F.upper(text), "'[^']*'|\"[^\"]*\"", " ")
    words = F.regexp_extract_all(plain, F.lit("[A-Z0-9][A-Z0-9-]*|="), F.lit(0))
    first = _map({v: role for v, (role, _) in ROLES.items()}, "map<string,string>")
    plainly = _map({f"{v} {k}": role for v, (_, keys) in ROLES.items() for k, role in keys.items()}, "map<string,string>")
    giving = _map({f"{v} {k}": role if k in ("GIVING", "REMAINDER") else "r" for v, (_, keys) in ROLES.items() if "GIVING" in keys for k, role in keys.items()}, "map<string,string>")
    start = lambda role: F.struct(F.array().cast(_OUT).alias("out"), role.alias("role"), F.lit(False).alias("of"))

    def step(a: Column, x: Column) -> Column:
        word, role = x["word"], x["role"]
        last = F.element_at(a["out"], -1)
        longer = F.concat(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), F.array(F.struct(last["name"].alias("name"), F.concat(last["of"], F.array(word)).alias("of"), last["role"].alias("role"))))
        more = F.concat(a["out"], F.array(F.struct(word.alias("name"), F.array().cast("array<string>").alias("of"), a["role"].alias("role"))))
        is_of = word.isin("OF", "IN") & (F.size(a["out"]) > 0)
        out = F.when(is_of | role.isNotNull(), a["out"]).when(a["of"], longer).otherwise(more)
        return F.struct(out.cast(_OUT).alias("out"), F.coalesce(role, a["role"]).alias("role"), is_of.alias("of"))

    def folded(words: Column) -> Column:
        verb = F.coalesce(F.get(words, 0), F.lit(""))
        key = lambda w: F.concat_ws(" ", verb, w)
        role = lambda w: F.when(F.array_contains(words, "GIVING"), F.coalesce(F.try_element_at(giving, key(w)), F.try_element_at(plainly, key(w)))).otherwise(F.try_element_at(plainly, key(w)))
        marked = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda w: F.struct(w.alias("word"), role(w).alias("role")))
        return F.filter(F.aggregate(marked, start(F.coalesce(F.try_element_at(first, verb), F.lit("-"))), step)["out"], lambda o: o["role"] != "-")

    return _bound(words, folded)


def item_paths(tree: DataFrame) -> DataFrame:
    """(file_id, ord, name, level, path, target, storage) from cobol.item_tree: the names of the groups around an item,
    inner ones first; target is the item itself, or for a level 88 the one that it is a condition of; storage the item
    whose bytes the target takes: itself, or what it redefines."""

    columns = ["ord", "name", "level", "parent", "redefines"]

    def build(*values: list) -> list[dict]:
        rows = {v[0]: dict(zip(columns, v)) for v in zip(*values)}
        named: dict[str, list[dict]] = {}
        for r in rows.values():
            named.setdefault(r["name"], []).append(r)
        out = []
        for r in rows.values():
            path, up = [], r["parent"]
            while up is not None:
                path.append(rows[up]["name"])
                up = rows[up]["parent"]
            target = rows[r["parent"]] if r["level"] == 88 and r["parent"] is not None else r
            over, storage = target, target["name"]
            while over is not None and over["redefines"] is not None:
                storage = over["redefines"]
                over = next((x for x in named.get(storage, []) if x["ord"] < over["ord"] and x["parent"] == over["parent"]), None)
            out.append({"path": path, "target": target["name"], "storage": storage})
        return out

    @F.arrow_udf("array<struct<path:array<string>,target:string,storage:string>>")
    def placed(ords: pa.Array, names: pa.Array, levels: pa.Array, parents: pa.Array, over: pa.Array) -> pa.Array:
        place = pa.struct([("path", pa.list_(pa.string())), ("target", pa.string()), ("storage", pa.string())])
        return pa.array([build(*f) for f in zip(*[c.to_pylist() for c in (ords, names, levels, parents, over)])], pa.list_(place))

    files = tree.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("i"))
    files = files.withColumn("p", placed(*[F.col("i")[c] for c in columns]))
    return files.select("file_id", F.explode(F.arrays_zip("i", "p")).alias("r")).select("file_id", "r.i.ord", "r.i.name", "r.i.level", "r.p.*")


def _within(of: Column, path: Column) -> Column:
    """Whether all qualifiers are among the groups around an item, in order from inside out."""
    def step(at: Column, q: Column) -> Column:
        place = F.array_position(F.slice(path, at + 1, F.size(path) + 1), q).cast("int")
        return F.when((at < 0) | (place == 0), -1).otherwise(at + place)

    return F.aggregate(of, F.lit(0), step) >= 0


def accesses(source: DataFrame) -> DataFrame:
    """(file_id, paragraph, item, storage, path, mode): the items that each paragraph reads (r) and writes (w), each
    once, with the bytes they take and the groups around them.

    A name that several items have is the one within its qualifiers, of several the first. Host variables of EXEC
    blocks count: those after INTO are written, the others read.
    """
    stated = statements.assemble(source).where(~F.upper("text").rlike("^EXEC\\s")).select("file_id", "paragraph", F.inline(operands(F.col("text"))))
    blocks = cobol.exec_blocks(source).select("file_id", F.col("line_start").alias("line_no"), "inputs", "outputs")
    held = blocks.join(cobol.paragraphs(source).select("file_id", F.col("name").alias("paragraph"), "line_start", "line_end").hint("merge"), "file_id").where("line_no > line_start and line_no <= line_end")
    host = lambda c, role: held.select("file_id", "paragraph", F.explode(c).alias("name"), F.array().cast("array<string>").alias("of"), F.lit(role).alias("role"))
    used = stated.unionByName(host("inputs", "r")).unionByName(host("outputs", "w")).distinct()
    items = item_paths(cobol.item_tree(cobol.data_items(source)))
    met = used.join(items.hint("merge"), ["file_id", "name"]).where(_within(F.col("of"), F.col("path")))
    one = met.withColumn("_k", F.row_number().over(Window.partitionBy("file_id", "paragraph", "name", "of", "role").orderBy("ord"))).where("_k = 1")
    modes = F.explode(F.when(F.col("role") == "rw", F.array(F.lit("r"), F.lit("w"))).otherwise(F.array("role")))
    return one.select("file_id", "paragraph", F.col("target").alias("item"), "storage", "path", modes.alias("mode")).distinct()
