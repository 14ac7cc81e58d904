"""Queries over imports of any depth, with DuckDB's SQL; the imports are written from each file to others by number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import imports as I
from siltstone.plans.registry import query
from siltstone.sources.repository import FILES, files
from siltstone.sources.shared import written

_BARE = r"regexp_replace({}, '\.[^./]*$', '')"
_FOUND = rf"""own as (select *, length(path) - length(replace(path, '/', '')) depth from files), n as (select count(*) n from files), found as (
  select a.path, repeat('../', depth) || case when depth = 0 then './' else '' end || case when a.doc_id % 4 = 0 then './x/../' else '' end || {_BARE.format('b.path')} name, 'javascript' "language" from own a cross join n join files b on b.doc_id = (a.doc_id * 3 + 1) % n.n where regexp_matches(b.path, '\.tsx?$')
  union select a.path, repeat('.', depth + 1) || replace({_BARE.format('b.path')}, '/', '.'), 'python' from own a cross join n join files b on b.doc_id = (a.doc_id * 5 + 2) % n.n where regexp_matches(b.path, '\.py$')
  union select path, '../../x' || doc_id, 'javascript' from own where doc_id % 9 = 1 union select path, 'react', 'javascript' from own where doc_id % 5 = 0 union select path, '.', 'python' from own where doc_id % 7 = 3)"""
_FOLDER = "regexp_replace({}, '/?[^/]*$', '')"
_NORMAL = (
    "list_reduce(list_concat([''], string_split({}, '/')), lambda a, x: case when a = '!' then a when x = '..' then case when a = '' then '!' else " + _FOLDER.format("a") + " end when x in ('.', '') then a when a = '' then x else a || '/' || x end)"
)
_SCRIPT = ", ".join(f"'{e}'" for e in I.SCRIPT)
_TRIED = rf"""whole as (select *, {_NORMAL.format("concat_ws('/', " + _FOLDER.format('path') + ", name)")} w, list_filter(string_split({_FOLDER.format('path')}, '/'), lambda x: x <> '') parts, length(name) - length(regexp_replace(name, '^\.+', '')) dots from (select distinct * from found) where starts_with(name, '.')),
module as (select *, array_to_string(list_concat(parts[:greatest(0, len(parts) - dots + 1)], list_filter(string_split(regexp_replace(name, '^\.+', ''), '.'), lambda x: x <> '')), '/') m from whole),
options as (select path, name, "language", case when "language" = 'python' then [m || '.py', case when m = '' then '__init__.py' else m || '/__init__.py' end] when w <> '!'
  then list_concat(list_transform([{_SCRIPT}], lambda e: regexp_replace(w, '([^/])\.[^./]+$', '\1') || e), list_transform([{_SCRIPT}], lambda e: case when w = '' then '' else w || '/' end || 'index' || e)) end o from module),
tried as (select path, name, "language", unnest(o) target, unnest(range(len(o))) pos from options),
first as (select path, name, "language", min_by(target, pos) file from tried where target in (select path from files) group by all),
resolved as (select path, name, "language", case when starts_with(name, '.') then file else name end target from found left join first using (path, name, "language"))"""
RESOLVED = f"{FILES}, {_FOUND}, {_TRIED}, edges as (select distinct path src, target dst from resolved where target in (select path from files))"


def found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(path, name, language) of imports that lead up from a file's folder and down again, missing ones and packages; and the files."""
    # the paths are made of the texts once: what follows reads them several times
    own = written(files(spark, sf_dir).select("doc_id", "path"), "paths")
    n, depth = own.count(), F.length("path") - F.length(F.regexp_replace("path", "/", ""))
    d, bare = F.col("doc_id"), F.regexp_replace("other", r"\.[^./]*$", "")
    other = own.select(d.alias("to"), F.col("path").alias("other"))
    by = lambda c: own.withColumn("to", c).join(other, "to").withColumn("depth", depth)
    script = F.concat(F.repeat(F.lit("../"), F.col("depth")), F.when(F.col("depth") == 0, "./").otherwise(""), F.when(d % 4 == 0, "./x/../").otherwise(""), bare)
    dotted = F.concat(F.repeat(F.lit("."), F.col("depth") + 1), F.regexp_replace(bare, "/", "."))
    rows = [
        by((d * 3 + 1) % n).filter(r"other rlike '\\.tsx?$'").select("path", script.alias("name"), F.lit("javascript").alias("language")),
        by((d * 5 + 2) % n).filter(r"other rlike '\\.py$'").select("path", dotted.alias("name"), F.lit("python").alias("language")),
        own.filter("doc_id % 9 = 1").select("path", F.concat(F.lit("../../x"), d).alias("name"), F.lit("javascript").alias("language")),
        own.filter("doc_id % 5 = 0").select("path", F.lit("react").alias("name"), F.lit("javascript").alias("language")),
        own.filter("doc_id % 7 = 3").select("path", F.lit(".").alias("name"), F.lit("python").alias("language")),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.distinct(), own


@query(f"with {RESOLVED} select * from resolved")
def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file that each relative import means; null where none is there, and packages under their name."""
    return I.resolve(*found(spark, sf_dir))


@query(
    f"""with {RESOLVED}, o as (select src path, count(*) imports from edges group by 1), b as (select dst path, count(*) imported_by from edges group by 1),
x as (select r.path, count(distinct name) filter (target is not null) packages, count(distinct name) filter (target is null) missing from resolved r anti join edges e on e.src = r.path and e.dst = r.target group by 1)
select path, coalesce(imports, 0) imports, coalesce(packages, 0) packages, coalesce(missing, 0) missing, coalesce(imported_by, 0) imported_by from (select distinct path from files) left join o using (path) left join x using (path) left join b using (path)"""
)
def import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with its imports and importers."""
    rows, own = found(spark, sf_dir)
    return I.nodes(own, I.resolve(rows, own))


@query(
    f"""with recursive {RESOLVED}, both_ways as (select src, dst, 'imports' side from edges union all select dst, src, 'importers' from edges), seeds as (select path, side from files, (values ('imports'), ('importers')) v(side) where doc_id % 20 = 0),
r(side, seed, path, hops) as (select side, path, path, 0 from seeds union select r.side, seed, dst, hops + 1 from r join both_ways b on b.src = r.path and b.side = r.side where hops < 4)
select side, seed, path, min(hops)::int hops from r group by 1, 2, 3"""
)
def import_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every twentieth file imports, and what imports it, in up to four steps."""
    rows, own = found(spark, sf_dir)
    forth = written(I.edges(I.resolve(rows, own), own), "edges")
    back = forth.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = own.filter("doc_id % 20 = 0").select("path")
    return I.reached(forth, seeds, 4).withColumn("side", F.lit("imports")).unionByName(I.reached(back, seeds, 4).withColumn("side", F.lit("importers")))
