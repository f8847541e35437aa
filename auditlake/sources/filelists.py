"""File lists, sources and snapshots (S26, S27, S29-S33, A14): whole files in, rows out."""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.functions.columns import fold_path, glob_regex, lower, project_path, resolve_path, stem, strip_comment, strip_comment_lines, strip_hdl_comments
from auditlake.operators.scratch import written
from auditlake.sources.lines import lines_of, plain_text

#: Commands and value options of Tcl lists, extensions of sources.
TCL_COMMAND = r"^\s*(?:add_files|read_verilog|read_vhdl|read_xdc|read_ip|read_mem|import_files)\b(.*)$"
TCL_VALUE_OPTIONS = ["-fileset", "-of_objects", "-copy_to", "-library", "-sub_design"]
SOURCES, VERILOG = r"(?i)\.(v|sv|vhd|vhdl|vh|svh)$", r"(?i)\.(v|sv|vh|svh)$"
#: Reserved words of IEEE 1364-2005, of IEEE 1800-2017 beside them, and of IEEE 1076-2008: none of them names a module.
VERILOG_2005 = """always and assign automatic begin buf bufif0 bufif1 case casex casez cell cmos config deassign default defparam
    design disable edge else end endcase endconfig endfunction endgenerate endmodule endprimitive endspecify endtable endtask event
    for force forever fork function generate genvar highz0 highz1 if ifnone incdir include initial inout input instance integer join
    large liblist library localparam macromodule medium module nand negedge nmos nor noshowcancelled not notif0 notif1 or output
    parameter pmos posedge primitive pull0 pull1 pulldown pullup pulsestyle_ondetect pulsestyle_onevent rcmos real realtime reg
    release repeat rnmos rpmos rtran rtranif0 rtranif1 scalared showcancelled signed small specify specparam strong0 strong1 supply0
    supply1 table task time tran tranif0 tranif1 tri tri0 tri1 triand trior trireg unsigned use uwire vectored wait wand weak0 weak1
    while wire wor xnor xor""".split()
SYSTEM_VERILOG_2017 = """accept_on alias always_comb always_ff always_latch assert assume before bind bins binsof bit break byte
    chandle checker class clocking const constraint context continue cover covergroup coverpoint cross dist do endchecker endclass
    endclocking endgroup endinterface endpackage endprogram endproperty endsequence enum eventually expect export extends extern
    final first_match foreach forkjoin global iff ignore_bins illegal_bins implements implies import inside int interconnect
    interface intersect join_any join_none let local logic longint matches modport nettype new nexttime null package packed priority
    program property protected pure rand randc randcase randsequence ref reject_on restrict return s_always s_eventually s_nexttime
    s_until s_until_with sequence shortint shortreal soft solve static string strong struct super sync_accept_on sync_reject_on
    tagged this throughout timeprecision timeunit type typedef union unique unique0 until until_with untyped var virtual void
    wait_order weak wildcard with within""".split()
VHDL_2008 = """abs access after alias all and architecture array assert assume assume_guarantee attribute begin block body buffer bus
    case component configuration constant context cover default disconnect downto else elsif end entity exit fairness file for force
    function generate generic group guarded if impure in inertial inout is label library linkage literal loop map mod nand new next
    nor not null of on open or others out package parameter port postponed procedure process property protected pure range record
    register reject release rem report restrict restrict_guarantee return rol ror select sequence severity shared signal sla sll sra
    srl strong subtype then to transport type unaffected units until use variable vmode vprop vunit wait when while with xnor
    xor""".split()
#: A name, and what may stand between the name of a module and that of its instance, and after that one.
_NAME = r"[A-Za-z_]\w*+"
_PARAMETERS, _RANGE = r"[ \t]*+#[ \t]*+\([^;]*?\)[ \t]*+", r"(?:\[[^\]]*+\][ \t]*+)?+"
INSTANCE = rf"(?m)^[ \t]*+({_NAME})(?:{_PARAMETERS}|[ \t]++){_NAME}[ \t]*+{_RANGE}\("
DECLARATION, VHDL_USE = rf"(?m)^\s*(?:module|entity)\s+({_NAME})", rf"(?i)\b(?:entity\s+(?:\w+\.)?|component\s+)({_NAME})"
DEPTH = 16


def list_entries(lists: DataFrame) -> DataFrame:
    """(path, ord, kind, value) of .f lists (path, text); kind is file, incdir, define or list.

    Comments go; -f and -F take the next token, also from the next line; other switches are left out.
    Paths are relative to their list.
    """
    # A switch and the token that it takes are one word, read from left to right: of switches in a row that want a name
    # the second is the first one's name, the third wants one again.
    bare = lists.select("path", strip_comment_lines(plain_text(F.col("text"))).alias("text"))
    words = F.filter(F.regexp_extract_all("text", F.lit(r"(?:-[fF]\s+)?\S+"), F.lit(0)), lambda w: w.rlike(r"^(?:[^-+]|-[fF]\s+\S|\+incdir\+|\+define\+)"))
    read = bare.select("path", F.posexplode(words).alias("ord", "word"))
    word = F.col("word")
    kind = F.when(word.rlike(r"^-[fF]\s"), "list").when(F.startswith(word, F.lit("+incdir+")), "incdir").when(F.startswith(word, F.lit("+define+")), "define").otherwise("file")
    read = read.select("path", "ord", kind.alias("kind"), F.regexp_replace(word, r"^(?:-[fF]\s+|\+incdir\+|\+define\+)", "").alias("token"))
    return read.select("path", "ord", "kind", F.when(F.col("kind") == "define", F.col("token")).otherwise(resolve_path(F.col("token"), F.col("path"))).alias("value"))


def list_counts(entries: DataFrame) -> DataFrame:
    """How many different files and include folders each list names."""
    each = entries.select("path", "kind", "value").distinct()
    return each.groupBy("path").agg(*(F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("file", "incdir")))


def ignored_modules(named: DataFrame, files: DataFrame) -> DataFrame:
    """Modules that no source need declare: those named so, and the stems of IP files."""
    return named.select("module").union(files.where(lower("path").endswith(".xci")).select(stem(F.col("path")))).distinct()


def tcl_entries(lists: DataFrame) -> DataFrame:
    """Files named by reading commands of Tcl lists; an option that takes a value takes the next word."""
    lines = lines_of(lists.select("path", "text")).withColumn("tail", F.regexp_extract(strip_comment(F.col("value")), TCL_COMMAND, 1)).where("tail <> ''")
    bare = F.filter(F.transform(F.regexp_extract_all("tail", F.lit(r'\{[^{}]*\}|"[^"]*"|\S+'), F.lit(0)), lambda t: F.regexp_replace(t, r'^[{"]|[}"]$', "")), lambda t: t != "")
    # An option in the place of another's value is that value, whatever it looks like: a line's words as letters, an
    # option that takes a value as w, and each of these blotted out with the word after it.
    told = lines.select("path", "ln", bare.alias("words"))
    marks = F.regexp_replace(F.array_join(F.transform("words", lambda w: F.when(w.isin(TCL_VALUE_OPTIONS), "w").otherwise("x")), ""), "w.", "__")
    told = told.select("path", "ln", "words", marks.alias("marks"))
    words = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: (F.substring(F.col("marks"), x["at"] + 1, F.lit(1)) == "x") & ~x["word"].rlike(r"^-\S+$"))
    files = told.select("path", "ln", F.explode(words).alias("x")).select("path", "ln", "x.at", "x.word")
    return files.select("path", "ln", "at", F.lit("file").alias("kind"), resolve_path(F.col("word"), F.col("path")).alias("value"))


def entries_of(lists: DataFrame) -> DataFrame:
    """(path, ord, kind, value) of lists (path, text) of both kinds; those named .tcl are Tcl."""
    tcl = F.endswith(lower("path"), F.lit(".tcl"))
    ordered = F.row_number().over(Window.partitionBy("path").orderBy("ln", "at")) - 1
    return list_entries(lists.where(~tcl)).unionByName(tcl_entries(lists.where(tcl)).withColumn("ord", ordered).select("path", "ord", "kind", "value"))


def _list_keys(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(root, path, key): the least key of each list that a root reaches. A round follows the lists whose keys the last
    one made better, so that its work is theirs.

    A better key can undo others only where it lies too deep to be followed while the one before was not: then all keys
    are improved together from the start, until none changes.
    """
    new = written(start, "list-keys")
    told = new
    for _ in range(64 * depth):
        met = new.where(F.size("key") < depth).join(edges, "path").select("root", F.col("nested").alias("path"), F.concat("key", F.array("ord")).alias("key"))
        met = written(met.groupBy("root", "path").agg(F.min("key").alias("key")), "list-met")
        held = told.join(met.select("root", "path"), ["root", "path"], "left_semi").groupBy("root", "path").agg(F.min("key").alias("_held"))
        new = written(met.join(held, ["root", "path"], "left").where("_held IS NULL OR key < _held"), "list-keys")
        if new.isEmpty():
            return told.groupBy("root", "path").agg(F.min("key").alias("key"))
        if not new.where((F.size("key") == depth) & F.col("_held").isNotNull()).isEmpty():
            return _list_keys_together(start, edges, depth)
        new = new.drop("_held")
        told = told.unionByName(new)
    raise RuntimeError("the keys of lists did not settle")


def _list_keys_together(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    at, was = written(start, "list-keys"), None
    for _ in range(64 * depth):
        now = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("root", "path", "key").cast("decimal(38,0)"))).first()
        if now == was:
            return at
        was = now
        met = at.where(F.size("key") < depth).join(edges, "path").select("root", F.col("nested").alias("path"), F.concat("key", F.array("ord")).alias("key"))
        at = written(start.unionByName(met).groupBy("root", "path").agg(F.min("key").alias("key")), "list-keys")
    raise RuntimeError("the keys of lists did not settle")


def flattened_lists(roots: DataFrame, entries: DataFrame, lists: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(root, ord, kind, value): all that a root list (path) names, itself and through others, depth first.

    kind: list (each visited list, the root first), file, incdir, define, or error. A list is read where it is met
    first in this order, so a list that names one above it, or one already read, adds nothing. A list that is not
    among lists (path) is an error, as is every mention of one more than `depth` levels down. entries are those of
    entries_of. A root without text is an error row; an empty table gives none.

    A list's place is a key: the ordinals on the way to it from the root. Keys sort as the order sorts, a list's key is
    the least that any list read on the way gives it, and keys are improved round by round. Edges between lists alone
    take part in the rounds, and of the keys those that the round before made better.
    """
    entries = written(entries, "list-entries")
    edges = written(entries.where("kind = 'list'").select("path", "ord", F.col("value").alias("nested")), "list-edges")
    start = roots.select(F.col("path").alias("root")).distinct().select("root", F.col("root").alias("path"), F.array().cast("array<int>").alias("key"))
    at = _list_keys(start, edges, depth)
    known = lists.select("path").distinct().withColumn("_known", F.lit(True))
    at = written(at, "list-keys")
    read = at.join(known, "path", "left")
    own = read.select("root", "key", F.lit("list").alias("kind"), F.col("path").alias("value"))
    gone = read.where("_known IS NULL").select("root", F.concat("key", F.array(F.lit(-1))).alias("key"), F.lit("error").alias("kind"), F.concat(F.lit("file list not found: "), "path").alias("value"))
    named = at.join(entries.withColumnRenamed("kind", "_kind"), "path").where((F.col("_kind") != "list") | (F.size("key") == depth))
    deep = F.col("_kind") == "list"
    rows = named.select("root", F.concat("key", F.array("ord")).alias("key"), F.when(deep, "error").otherwise(F.col("_kind")).alias("kind"), F.when(deep, F.concat(F.lit("file list nesting too deep at "), "value")).otherwise(F.col("value")).alias("value"))
    every = own.unionByName(gone).unionByName(rows)
    return every.select("root", (F.row_number().over(Window.partitionBy("root").orderBy("key")) - 1).alias("ord"), "kind", "value")


def reached_lists(roots: DataFrame, entries: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(path, depth) of lists that roots name, themselves or through others; each list is followed
    once, at its least depth. Levels are written, and the rounds end with the first empty one."""
    edges = entries.where("kind = 'list'").select(F.col("path").alias("owner"), F.col("value").alias("nested")).distinct()
    level = written(roots.select("path").distinct().withColumn("depth", F.lit(0)), "lists")
    out = level
    for d in range(1, depth + 1):
        level = level.join(edges, F.col("path") == F.col("owner")).select(F.col("nested").alias("path")).distinct()
        level = written(level.join(out, "path", "left_anti").withColumn("depth", F.lit(d)), "lists")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def module_sides(files: DataFrame) -> DataFrame:
    """(path, module, declares, uses, raw) of source files (path, text), once for each name of a file: whether it
    is declared there, instantiated there, and declared in the text with its comments. A source's own reserved words are no
    modules."""
    src = files.where(F.col("path").rlike(SOURCES)).withColumn("_verilog", F.col("path").rlike(VERILOG))
    body = F.when(F.col("_verilog"), strip_hdl_comments(F.col("text"))).otherwise(strip_hdl_comments(F.col("text"), False))
    src = src.withColumn("_body", body)
    found = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    uses = F.when(F.col("_verilog"), found("_body", INSTANCE)).otherwise(found("_body", VHDL_USE))
    words = F.when(F.col("_verilog"), F.lit(VERILOG_2005 + SYSTEM_VERILOG_2017)).otherwise(F.lit(VHDL_2008))
    tagged = lambda names, side: F.transform(F.array_distinct(names), lambda m: F.struct(m.alias("module"), F.lit(side).alias("side")))
    sides = F.concat(tagged(found("_body", DECLARATION), "declares"), tagged(F.filter(uses, lambda m: ~F.array_contains(words, lower(m))), "uses"), tagged(found("text", DECLARATION), "raw"))
    rows = src.select("path", F.explode(sides).alias("s")).select("path", "s.module", "s.side")
    return rows.groupBy("path", "module").agg(*(F.bool_or(F.col("side") == s).alias(s) for s in ("declares", "uses", "raw")))


def module_edges(files: DataFrame) -> DataFrame:
    """(path, module, edge) with edge declares or instantiates, of source files (path, text).

    Names that only the files declaring them use are declarations, not uses.
    """
    sides = written(module_sides(files).select("path", "module", "declares", "uses"), "sides")
    return edges_of(sides, [])


def edges_of(sides: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, module, edge) of rows of module_sides, those of one key together."""
    own = sides.where("declares OR uses").groupBy(*keys, "module").agg(F.bool_and(F.col("declares") & F.col("uses")).alias("_same")).where("_same").select(*keys, "module")
    uses = sides.where("uses").join(own, [*keys, "module"], "left_anti")
    edge = lambda rows, name: rows.select(*keys, "path", "module", F.lit(name).alias("edge"))
    return edge(sides.where("declares"), "declares").unionByName(edge(uses, "instantiates"))


_PROJECT = "FileSets struct<FileSet: array<struct<_Name: string, File: array<struct<_Path: string>>, Config: array<struct<Option: array<struct<_Name: string, _Val: string>>>>>>>"


def project_files(projects: DataFrame) -> DataFrame:
    """(path, fileset, kind, value) of project files (path, text): kind is source, constraint or simulation by
    the fileset's name. A text that is no project gives no rows."""
    parsed = projects.select("path", F.from_xml("text", _PROJECT).alias("p")).select("path", F.explode("p.FileSets.FileSet").alias("s"))
    name = lower(F.coalesce("s._Name", F.lit("")))
    kind = F.when(F.contains(name, F.lit("constr")), "constraint").when(F.contains(name, F.lit("sim")), "simulation").otherwise("source")
    files = parsed.select("path", F.col("s._Name").alias("fileset"), kind.alias("kind"), F.explode("s.File").alias("f")).where("f._Path <> ''")
    return files.select("path", "fileset", "kind", project_path(F.col("f._Path"), F.col("path")).alias("value"))


def project_tops(projects: DataFrame) -> DataFrame:
    """(path, top): the first TopModule option of a project, null where it has none."""
    sets = F.from_xml("text", _PROJECT)["FileSets"]["FileSet"]
    options = F.flatten(F.flatten(F.transform(sets, lambda s: F.transform(F.coalesce(s["Config"], F.array()), lambda c: F.coalesce(c["Option"], F.array())))))
    top = F.filter(options, lambda o: (o["_Name"] == "TopModule") & (o["_Val"] != ""))
    return projects.select("path", F.get(F.transform(top, lambda o: o["_Val"]), F.lit(0)).alias("top"))


def path_list(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path): the distinct paths of plain lists (keys, text), folded, less comments and blank lines."""
    rows = lines_of(files.select(*keys, "text")).select(*keys, F.trim("value").alias("entry")).where("entry <> '' AND NOT startswith(entry, '#')")
    return rows.select(*keys, fold_path(F.col("entry")).alias("path")).distinct()


#: Bytes of a file that are held at a time while it is hashed.
CHUNK_BYTES = 1 << 22


def file_stats(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, sha256, size, mtime, missing) of each distinct path, of files of any size and anywhere that pyarrow reaches.

    A task reads its files chunk by chunk, so no file is ever a row. A path that is no file has missing true and nulls
    else; a file that goes while it is read is missing too. Null paths are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_stat(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.timestamp("us", "UTC"))))], ["path", "sha256", "size", "mtime"])

    spread = paths.where(F.col(path).isNotNull()).select(F.col(path).alias("path")).distinct()
    found = spread.mapInArrow(run, "path string, sha256 string, size long, mtime timestamp")
    return found.select("path", "sha256", "size", F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss").alias("mtime"), F.col("sha256").isNull().alias("missing"))


def _stat(path: str) -> tuple[str | None, int | None, datetime.datetime | None]:
    files, place = _reached(path)
    info = files.get_file_info(place)
    if info.type != FileType.File:
        return None, None, None
    digest, size = hashlib.sha256(), 0
    try:
        with files.open_input_stream(place) as source:
            while chunk := source.read(CHUNK_BYTES):
                digest.update(chunk)
                size += len(chunk)
    except FileNotFoundError:
        return None, None, None
    return digest.hexdigest(), size, info.mtime


def files_under(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path) of all files under a folder whose names fit a glob, empty ones among them; nothing of them is read.

    Folders are listed level by level, those of a level by many tasks at once, and each level is written. A folder
    that is not there has no files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, place = _reached(path)
                infos = files.get_file_info(FileSelector(place, allow_not_found=True))
                names = [f"{path.rstrip('/')}/{i.base_name}" for i in infos]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([i.type == FileType.Directory for i in infos], pa.bool_())], ["path", "folder"])

    level, out = spark.createDataFrame([(folder,)], "path string"), None
    while True:
        found = written(level.mapInArrow(run, "path string, folder boolean"), "listed")
        out = found if out is None else out.unionByName(found)
        level = found.where("folder").select("path").repartition(F.col("path"))
        if found.where("folder").isEmpty():
            break
    return out.where(~F.col("folder") & F.substring_index("path", "/", -1).rlike(glob_regex(pattern))).select("path")


def _reached(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


def file_records(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, sha256, size, mtime, missing) of all files under a folder."""
    return file_stats(files_under(spark, folder, pattern))


def checksums(records: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """Path and first 12 digits of every file that no pattern leaves out."""
    out = [F.col("path").rlike(glob_regex(p)) for p in excluded or []]
    kept = records.where(~F.greatest(F.lit(False), *out)) if out else records
    return kept.select(F.left("sha256", F.lit(12)).alias("sha256"), "path")
