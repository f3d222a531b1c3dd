"""Cross-reference resolution as joins: imports, inheritance, references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import base_dir, join_path
from ..schema import EXTENSIONS


#: Line ranges are cut at multiples of powers of BASE, up to BASE ** TOP.
BASE, TOP = 8, 7
#: Blocks of levels below this one are shuffled by the block of this level that they lie in.
COARSE = 5
#: About so many sources, and files, of a folder meet in one group of a join.
BLOCK = 1024


def _covering(start, end):
    """The fewest aligned blocks (level, block) that make up the lines start to end: block b of level k has the
    lines from b * BASE ** k on.  Some 14 of them for each level that the range fills."""
    low = lambda k: F.ceil(start / F.lit(BASE**k)).cast("long")
    high = lambda k: F.floor((end + 1) / F.lit(BASE**k)).cast("long")
    run = lambda k, a, b: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda x: F.struct(F.lit(k).alias("level"), x.alias("block")))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))
    parts = []
    for k in range(TOP + 1):
        whole = run(k, low(k), high(k))
        if k < TOP:
            a, b = low(k + 1), high(k + 1)
            whole = F.when(a < b, F.concat(run(k, low(k), a * BASE), run(k, b * BASE, high(k)))).otherwise(whole)
        parts.append(whole)
    return F.concat(*parts)


def enclosing_functions(points: DataFrame, functions: DataFrame) -> DataFrame:
    """(ref_path, ref_line, src): for each distinct point the first function by (``ord``, id) that holds it, if any.

    A range is some blocks and a line is in one block of each level, so "holds" is an equality.  Of the functions
    of a block only the first counts, so a line meets one row a level, however many functions nest or lie in its
    file.  A function and a line are shuffled once for all small blocks of a large one, and cut into these where they
    meet; keys are still blocks, so a large file is spread like any other.
    """
    struct = lambda level, block: F.struct(level.cast("int").alias("level"), block.cast("long").alias("block"))
    # the key of small blocks is the large one that they lie in, with the level -1
    key = lambda x: F.when(x.level >= COARSE, struct(x.level, x.block)).otherwise(struct(F.lit(-1), F.floor(x.block / F.pow(F.lit(BASE), COARSE - x.level))))
    f = functions.where("start_line <= end_line").select("file_path", F.struct("ord", "id").alias("first"), "start_line", "end_line", F.lit(None).cast("long").alias("line"))
    f = f.select("*", F.inline(F.array_distinct(F.transform(_covering(F.col("start_line"), F.col("end_line")), key))))
    p = points.select("ref_path", "ref_line").where("ref_path is not null and ref_line is not null").distinct()
    at = lambda k: F.floor(F.col("ref_line") / F.lit(BASE**k))
    p = p.select(F.col("ref_path").alias("file_path"), F.col("ref_line").cast("long").alias("line"), F.inline(F.array(struct(F.lit(-1), at(COARSE)), *[struct(F.lit(k), at(k)) for k in range(COARSE, TOP + 1)])))
    # a number that stays: partitions put together by their size before they are cut would be too large after it
    n = int(functions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = f.unionByName(p, allowMissingColumns=True).repartition(n, "file_path", "level", "block")
    low, high, line = F.col("block") * F.lit(BASE**COARSE), (F.col("block") + 1) * F.lit(BASE**COARSE) - 1, F.col("line")
    small = F.when(line.isNull(), _covering(F.greatest("start_line", low), F.least("end_line", high))).otherwise(F.array(*[struct(F.lit(k), F.floor(line / F.lit(BASE**k))) for k in range(COARSE)]))
    blocks = F.when(F.col("level") >= COARSE, F.array(struct(F.col("level"), F.col("block")))).otherwise(small)
    met = met.select("file_path", "level", "block", "first", "line", F.explode(blocks).alias("small"))
    hits = met.groupBy("file_path", "level", "block", "small").agg(F.min("first").alias("first"), F.collect_list("line").alias("lines")).where("first is not null")
    hits = hits.select(F.col("file_path").alias("ref_path"), F.explode("lines").alias("ref_line"), "first")
    return hits.groupBy("ref_path", "ref_line").agg(F.min("first").alias("first")).select("ref_path", "ref_line", F.col("first.id").alias("src"))


def references_by_file(refs: DataFrame, functions: DataFrame) -> DataFrame:
    """The edges of ``resolve_references`` with the file that each lies in: (ref_path, src, dst)."""
    r = refs.groupBy("callee_id", "ref_path", "ref_line").agg(F.count("*").cast("int").alias("times"))
    found = r.join(enclosing_functions(r, functions), ["ref_path", "ref_line"])
    return found.where("src <> callee_id").select("ref_path", "src", F.col("callee_id").alias("dst"), F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("col")


def resolve_references(refs: DataFrame, functions: DataFrame) -> DataFrame:
    """CALLS edges (src, dst): for each reference (callee_id, ref_path, ref_line) the enclosing function.

    ``functions`` has id, file_path, start_line, end_line and ``ord``, the order of extraction; the first
    that holds the line wins.  Every reference is a row of its own; references outside any function or
    inside the callee itself give none.  Equal references are counted first and told apart by nothing else, so
    a task that is run again gives the same rows.
    """
    return references_by_file(refs, functions).select("src", "dst")


def inherited(implements: DataFrame, classes: DataFrame) -> DataFrame:
    """``implements`` with ``dst``, the first class of the name ``to_class_name`` by (file_path, id), where that is another than ``from_class_id``."""
    target = classes.groupBy("name").agg(F.min_by("id", F.struct("file_path", "id")).alias("dst"))
    return implements.join(target.withColumnRenamed("name", "to_class_name"), "to_class_name").where("from_class_id <> dst")


def resolve_inheritance(implements: DataFrame, classes: DataFrame) -> DataFrame:
    """IMPLEMENTS edges: each (from_class_id, to_class_name) to the first class of that name by (file_path, id)."""
    return inherited(implements.select("from_class_id", "to_class_name"), classes).select(F.col("from_class_id").alias("src"), "dst")


def _based(imports: DataFrame) -> DataFrame:
    """(source_path, path) with ``base``, the path that an import with a leading dot means."""
    return imports.select("source_path", "path").withColumn("base", F.when(F.col("path").startswith("."), join_path(base_dir(F.col("source_path")), F.col("path"))))


def _stems(f: DataFrame) -> DataFrame:
    """(base, rank) of files: the path before an extension, and the place of the extension."""
    cut = lambda k, e: F.when(F.col("dst").endswith(e), F.struct(F.expr(f"substring(dst, 1, length(dst) - {len(e)})").alias("base"), F.lit(k).alias("rank")))
    return f.select(F.coalesce(*[cut(k, e) for k, e in enumerate(EXTENSIONS)]).alias("s")).where("s is not null").select("s.base", "s.rank")


def _folders(path) -> F.Column:
    """The folders above a path, the root ('') among them."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k - 1), "/"))


def _beginning(bases: DataFrame, f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base, dir) of folders whose own path begins with a base, so that each of their files' does, and
    (base, dst) of files whose folder's path is shorter than the base.

    Of a path's beginnings only those as long as some base in the same folder are made, a few for each folder
    above it; what then meets is equal, at the root as elsewhere.
    """
    lengths = bases.select(base_dir(F.col("base")).alias("up"), F.length("base").alias("k")).distinct()
    dirs = f.select("dir").distinct().select("dir", F.explode(F.array_distinct(_folders(F.col("dir")))).alias("up"))
    heads = dirs.join(lengths, "up").where(F.length("dir") >= F.col("k")).select(F.expr("substring(dir, 1, k)").alias("base"), "dir").distinct()
    names = f.select("dst", F.col("dir").alias("up")).join(lengths, "up").where((F.length("dst") >= F.col("k")) & (F.col("k") > F.length("up"))).select(F.expr("substring(dst, 1, k)").alias("base"), "dst")
    return heads, names


def _cut(imports: DataFrame) -> DataFrame:
    """(source_path, joined): imports cut at dots and slashes, their parts joined by slashes."""
    return imports.select("source_path", F.array_join(F.filter(F.split("path", "[./]"), lambda x: x != ""), "/").alias("joined")).where("joined <> ''")


def _loose(cut: DataFrame, f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(joined, dir) of folders that occur in a cut import, and (joined, dst) of files at the root whose stem is its last part.

    Equal cut imports are looked up once, however many files have them.
    """
    cut = cut.select("joined").distinct()
    # every directory that occurs in the joined import is one of its substrings: an equality join on those
    # short strings instead of a comparison of all files with all imports
    dirs = f.where("dir <> ''").select("dir").distinct()
    # only substrings as long as some directory that begins with the same three characters are made
    heads = dirs.select(F.substring("dir", 1, 3).alias("head"), F.length("dir").alias("k")).distinct()
    starts = cut.select("joined", F.explode(F.sequence(F.lit(1), F.length("joined"))).alias("a")).withColumn("head", F.expr("substring(joined, a, 3)"))
    # a directory of one or two characters is a head by itself, inside a longer one of the import too
    starts = starts.select("joined", "a", F.explode(F.array_distinct(F.array(F.substring("head", 1, 1), F.substring("head", 1, 2), "head"))).alias("head"))
    subs = starts.join(heads, "head").where(F.col("a") + F.col("k") - 1 <= F.length("joined")).select("joined", F.expr("substring(joined, a, k)").alias("dir"))
    stems = f.where("dir = ''").select("dst", F.regexp_replace("dst", r"\.[^.]*$", "").alias("stem"))
    return subs.join(dirs, "dir", "left_semi").select("joined", "dir").distinct(), cut.withColumn("stem", F.substring_index("joined", "/", -1)).join(stems, "stem").select("joined", "dst")


def _files_of(whole: DataFrame, f: DataFrame, parts) -> DataFrame:
    """Each distinct (source_path, dir) with each file of the folder.

    A folder's sources and its files are cut into blocks of about ``BLOCK`` rows by their hashes, and blocks meet
    in pairs, so a folder that very many sources import is spread like many small ones.
    """
    blocks = lambda df, name: df.groupBy("dir").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias(name))
    sizes = blocks(whole, "of_sources").join(blocks(f, "of_files"), "dir")
    block = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int").alias(column[0])
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    a = whole.join(sizes, "dir").select("source_path", *parts("source_path"), "dir", block("source_path", "of_sources"), every("of_files", "d"))
    b = f.join(sizes, "dir").select("dst", *parts("dst"), "dir", block("dst", "of_files"), every("of_sources", "s"))
    keys, n = ["dir", "s", "d"], int(f.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.repartition(n, *keys).join(b.repartition(n, *keys).hint("merge"), keys)


def _with_folders(paths: DataFrame) -> DataFrame:
    """Distinct (dst, dir) of files (path)."""
    return paths.select(F.col("path").alias("dst")).distinct().withColumn("dir", base_dir(F.col("dst")))


def sort_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct imports (source_path, path) by what they mean, which one of three columns says: the file ``dst``, all files whose
    path begins with ``base``, or those that ``path`` meets when it is cut at dots and slashes."""
    i, f = _based(imports.distinct()), _with_folders(files)
    above = f.select("dir").distinct().select(F.explode(F.array_append(_folders(F.col("dir")), F.col("dir"))).alias("base")).where("base <> ''")
    known = _stems(f).unionByName(above.withColumn("rank", F.lit(None).cast("int"))).groupBy("base").agg(F.min("rank").alias("rank")).withColumn("there", F.lit(True))
    end = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), F.col("rank") + 1)
    dotted = i.where("base is not null").join(known, "base", "left")
    none = F.lit(None).cast("string")
    dotted = dotted.select("source_path", F.when(F.col("rank").isNotNull(), F.concat("base", end)).alias("dst"), F.when(F.col("rank").isNull() & F.col("there"), F.col("base")).alias("base"), F.when(F.col("there").isNull(), F.col("path")).alias("path"))
    return dotted.unionByName(i.where("base is null").select("source_path", none.alias("dst"), none.alias("base"), "path"))


def met_folders(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (source_path, dir, dst) of sorted imports: a source with a whole folder ``dir``, or else with a single file ``dst``.

    A file of a folder that is met whole is not met singly.
    """
    f = _with_folders(files)
    i, cut = imports.where("base is not null").select("source_path", "base").distinct(), _cut(imports.where("path is not null"))
    (heads, names), (within, stems) = _beginning(i, f), _loose(cut, f)
    whole = i.join(heads, "base").select("source_path", "dir").unionByName(cut.join(within, "joined").select("source_path", "dir")).distinct()
    single = imports.where("dst is not null").select("source_path", "dst").unionByName(i.join(names, "base").select("source_path", "dst")).unionByName(cut.join(stems, "joined").select("source_path", "dst"))
    single = single.distinct().withColumn("dir", base_dir(F.col("dst"))).join(whole, ["source_path", "dir"], "left_anti")
    none = F.lit(None).cast("string")
    return whole.withColumn("dst", none).unionByName(single.withColumn("dir", none))


def import_pairs(met: DataFrame, files: DataFrame, ordered: bool = False) -> DataFrame:
    """(src, dst): each source with each file that it meets, by folders or singly, without itself."""
    # the parts of paths are cut before pairs are made
    parts = lambda column: [F.split(column, "/").alias(f"{column}_parts")] if ordered else []
    single = met.where("dst is not null").select("source_path", *parts("source_path"), "dst", *parts("dst"))
    pairs = _files_of(met.where("dir is not null").select("source_path", "dir"), _with_folders(files), parts).select(*single.columns).unionByName(single).where("source_path <> dst")
    if ordered:
        pairs = pairs.where("source_path_parts > dst_parts")
    return pairs.select(F.col("source_path").alias("src"), "dst")


def resolve_imports(imports: DataFrame, files: DataFrame, ordered: bool = False) -> DataFrame:
    """(src, dst) file pairs of imports (source_path, path), each pair once, self imports left out.

    An import that starts with a dot is joined to its file's directory: the first existing file by extension
    order wins; else, if that is a directory, every file whose path starts with it.  Any other, or one that
    found nothing, is cut at dots and slashes, and a file matches if its directory occurs in the cut import
    joined by slashes, or, at the root, if the last part is the file's stem.  ``ordered`` keeps only pairs
    whose source comes after its target by path components.

    Pairs can be as many as sources times files, so they are made last and never shuffled: sources are paired
    with whole folders and with single files, each once.
    """
    return import_pairs(met_folders(sort_imports(imports.select("source_path", "path"), files), files), files, ordered)


def affected_sources(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """(source_path) of imports that may resolve to other files once the files ``paths`` (path) have come or gone.

    Whether an import finds a file, a directory or neither depends on files that one of the three rules lets it
    meet; so if it meets none of these, it resolves as before.
    """
    f, cut = _with_folders(paths), _cut(imports)
    i = _based(imports).where("base is not null").select("source_path", "base")
    begun, loose = [[df.select(column) for df in met] for column, met in (("base", _beginning(i, f)), ("joined", _loose(cut, f)))]
    bases = reduce(DataFrame.unionByName, [*begun, _stems(f).select("base")]).distinct()
    return i.join(bases, "base", "left_semi").select("source_path").unionByName(cut.join(reduce(DataFrame.unionByName, loose).distinct(), "joined", "left_semi").select("source_path")).distinct()
