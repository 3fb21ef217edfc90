"""Typed properties in JSON to plain JSON values, without leaving the JVM.

A property is ``{"type": t, t: value}``.  What doesn't have the shape its type asks for
becomes ``{"type": t, "raw": property}``, so conversion never loses a value.  Results
are JSON texts; an absent key is left out, a null is ``null``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.sources.batches import over

_USER, _NAMED = "struct<id:string,name:string>", "struct<name:string>"


def _at(prop: Column, path: str) -> Column:
    return F.get_json_object(prop, f"$.{path}")


def _null(prop: Column, key: str) -> Column:
    """Whether the property's own value is there and null."""
    return F.coalesce(F.array_contains(F.json_object_keys(prop), key), F.lit(False)) & _at(prop, key).isNull()


def _items(prop: Column, key: str, item: str) -> Column:
    """The items of an array value; null for what is no array."""
    value = _at(prop, key)
    return F.when(value.startswith("["), F.from_json(value, f"array<{item}>"))


def quoted(text: Column) -> Column:
    """``text`` as a JSON string; null for none."""
    held = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), F.substring(held, F.lit(6), F.length(held) - 6))


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def fallback(kind: Column, raw: Column) -> Column:
    return F.concat(F.lit('{"type":'), quoted(kind), F.lit(',"raw":'), raw, F.lit("}"))


def plain_text(prop: Column, key: str) -> Column:
    """The texts of a list of rich text joined, null for no list."""
    items = _items(prop, key, "struct<plain_text:string,text:struct<content:string>>")
    return F.array_join(F.transform(items, lambda p: F.coalesce(p["plain_text"], p["text"]["content"], F.lit(""))), "")


def _user(u: Column) -> Column:
    return F.to_json(F.struct(u["id"].alias("id"), u["name"].alias("name")))


def date(value: Column) -> Column:
    start, end, zone = (F.get_json_object(value, f"$.{k}") for k in ("start", "end", "time_zone"))
    return F.when(value.isNull(), "null").when(start.isNull(), value).when(end.isNull() & zone.isNull(), quoted(start)).otherwise(F.to_json(F.struct(start.alias("start"), end.alias("end"), zone.alias("timeZone"))))


def _scalar(prop: Column, kind: Column) -> Column:
    """A string value with a key of its type's name."""
    out = F.lit(None).cast("string")
    for key in ("url", "email", "phone_number", "created_time", "last_edited_time"):
        out = F.when(kind == key, F.when(_null(prop, key), "null").when(_at(prop, key).isNotNull(), quoted(_at(prop, key)))).otherwise(out)
    return out


def _typed(value: Column) -> Column:
    """A formula's or rollup's value by its own type; arrays keep their JSON."""
    kind = F.get_json_object(value, "$.type")
    of = lambda k: F.get_json_object(value, f"$.{k}")
    return (
        F.when(kind == "string", F.coalesce(quoted(of("string")), F.lit("null"))).when(kind == "number", F.coalesce(of("number"), F.lit("null")))
        .when(kind == "boolean", F.coalesce(of("boolean"), F.lit("null"))).when(kind == "date", date(of("date"))).when(kind == "array", F.coalesce(of("array"), F.lit("[]"))).otherwise(F.coalesce(value, F.lit("null")))
    )


def convert(prop: Column) -> Column:
    """A property's JSON value."""
    kind = _at(prop, "type")
    back = fallback(F.coalesce(kind, F.lit("unknown")), prop)
    number, names = _at(prop, "number"), lambda key: F.filter(F.transform(_items(prop, key, _NAMED), lambda x: quoted(x["name"])), lambda x: x.isNotNull())
    people = F.transform(F.filter(_items(prop, "people", _USER), lambda u: u["id"].isNotNull()), _user)
    files = F.filter(F.transform(_items(prop, "files", "struct<name:string,type:string,file:struct<url:string>,external:struct<url:string>>"), lambda f: F.struct(f["name"].alias("name"), F.when(f["type"] == "file", f["file"]["url"]).when(f["type"] == "external", f["external"]["url"]).alias("url"))), lambda f: f["name"].isNotNull() & f["url"].isNotNull())
    links = F.transform(F.filter(_items(prop, "relation", "struct<id:string>"), lambda r: r["id"].isNotNull()), lambda r: quoted(r["id"]))
    more = F.when(_at(prop, "has_more").isNotNull(), F.concat(F.lit(',"hasMore":'), _at(prop, "has_more"))).otherwise("")
    one = lambda key: F.from_json(_at(prop, key), _USER)
    inner = F.when(kind == "formula", _at(prop, "formula")).otherwise(_at(prop, "rollup"))
    unique, prefix = _at(prop, "unique_id.number"), _at(prop, "unique_id.prefix")
    out = (
        F.when(kind == "title", quoted(plain_text(prop, "title"))).when(kind == "rich_text", quoted(plain_text(prop, "rich_text")))
        .when(kind == "number", F.when(_null(prop, "number"), "null").when(number.rlike(r"^-?\d"), number))
        .when(kind == "select", F.coalesce(quoted(_at(prop, "select.name")), F.lit("null"))).when(kind == "status", F.coalesce(quoted(_at(prop, "status.name")), F.lit("null")))
        .when(kind == "multi_select", _list(names("multi_select"))).when(kind == "date", date(_at(prop, "date"))).when(kind == "people", _list(people))
        .when(kind == "files", _list(F.transform(files, lambda f: F.to_json(f))))
        .when(kind == "checkbox", F.when(_at(prop, "checkbox").isin("true", "false"), _at(prop, "checkbox")))
        .when(kind.isin("url", "email", "phone_number", "created_time", "last_edited_time"), _scalar(prop, kind))
        .when(kind.isin("formula", "rollup"), F.concat(F.lit('{"value":'), _typed(inner), F.lit(',"raw":'), F.coalesce(inner, F.lit("null")), F.lit("}")))
        .when(kind == "relation", F.concat(F.lit('{"value":'), _list(links), F.lit(',"raw":'), _at(prop, "relation"), more, F.lit("}")))
        .when(kind.isin("created_by", "last_edited_by"), F.when(kind == "created_by", F.when(one("created_by")["id"].isNotNull(), _user(one("created_by")))).otherwise(F.when(one("last_edited_by")["id"].isNotNull(), _user(one("last_edited_by")))))
        .when(kind == "unique_id", F.when(unique.rlike(r"^-?\d"), quoted(F.concat(F.when(F.coalesce(prefix, F.lit("")) != "", F.concat(prefix, F.lit("-"))).otherwise(""), unique))))
    )
    return F.coalesce(out, back)


def page_title(properties: Column) -> Column:
    """The text of the first property, in the object's own order, that is a title."""
    values = F.map_values(F.from_json(properties, "map<string,string>"))
    titles = F.filter(values, lambda p: (_at(p, "type") == "title") & _at(p, "title").startswith("["))
    return F.coalesce(F.array_join(F.transform(F.from_json(_at(F.get(titles, F.lit(0)), "title"), "array<struct<plain_text:string>>"), lambda t: F.coalesce(t["plain_text"], F.lit(""))), ""), F.lit(""))


def stabilised(value: object) -> tuple[object, int, int]:
    """A JSON value with the signed URLs of its strings cut, at any depth; how many were, and how many couldn't be.

    The URL of a hosted file loses its query whatever it is; that of an external one stays.
    """
    from foliate.functions import destinations

    if isinstance(value, str):
        text, done, unsafe = destinations.signed_urls(value)
        return text, done, len(unsafe)
    done = unsafe = 0
    if isinstance(value, list):
        out = []
        for x in value:
            y, a, b = stabilised(x)
            out.append(y)
            done, unsafe = done + a, unsafe + b
        return out, done, unsafe
    if isinstance(value, dict):
        made = {}
        for k, x in value.items():
            if k == "external" and isinstance(x, dict) and isinstance(x.get("url"), str):
                y, a, b = stabilised({i: j for i, j in x.items() if i != "url"})
                y = {i: x["url"] if i == "url" else y[i] for i in x}
            elif k == "file" and isinstance(x, dict) and isinstance(x.get("url"), str):
                bare = x["url"].split("?")[0].split("#")[0] if x["url"].startswith(("http://", "https://")) else x["url"]
                y, a, b = stabilised({i: j for i, j in x.items() if i != "url"})
                y, a = {i: bare if i == "url" else y[i] for i in x}, a + (bare != x["url"])
            else:
                y, a, b = stabilised(x)
            made[k], done, unsafe = y, done + a, unsafe + b
        return made, done, unsafe
    return value, 0, 0


def stabilise(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` (JSON) stabilised, and the counts ``replaced`` and ``unsafe``."""
    import json

    names, at = rows.columns, rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(None, 0, 0) if t is None else stabilised(json.loads(t)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([None if t is None else json.dumps(m[0], ensure_ascii=False, separators=(",", ":")) for t, m in zip(batch.column(at).to_pylist(), made, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([m[k] for m in made], pa.int64()) for k in (1, 2))], names=[*names, "replaced", "unsafe"])

    return over(rows, run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", replaced long, unsafe long")
