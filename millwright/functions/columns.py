"""Scalar functions: times, paths, classes, costs, flags, log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of sources, by language; anything else is "other".
CUDA, CPP, C, HEADER = ("cu", "cuh"), ("cpp", "cc", "cxx"), ("c",), ("h", "hpp", "hxx")
# Fixed values.
#: Signs of generated files.
GENERATED = r"\.pb\.h$|\.pb\.cc$|_generated\.h$|moc_.*\.cpp$|ui_.*\.h$|\.tab\.c$|\.tab\.h$|lex\.yy\.c$"
#: Flags that change what a unit depends on: those that may take the next argument, and those that never do.
VALUE_FLAGS = ("-I", "-D", "-U", "-isystem", "-iquote", "-include", "-imacros", "-idirafter", "-iprefix", "-isysroot")
JOINED_FLAGS = ("-std=", "-stdlib=")
#: An include line.
INCLUDE = r'(?m)^\s*#\s*include\s*[<"][^>"]+[>"]'
#: Folders of the phases of a layered project, and fragments of paths that only build locally.
PHASES = (("/foundation/", 1), ("/middleware/", 2), ("/application/", 3))
LOCAL_ONLY = ("/producer/spinnaker", "/producer/flir", "/gpu/", "/net/", "/gui/", "/python/openpose/")
#: Compile seconds by size: up to these kilobytes, seconds at the piece's beginning and for each further kilobyte.
SIZE_PIECES = ((0, 0.5, 0.15), (10, 2.0, 0.2), (50, 10.0, 0.27), (200, 50.0, 0.5))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Seconds from one timestamp to the other; null where either is null."""
    return (F.unix_micros(end) - F.unix_micros(start)) / 1_000_000


def task_durations() -> tuple[Column, Column]:
    """queue_seconds (created to scheduled) and exec_seconds (started to completed)."""
    return seconds_between("created_at", "scheduled_at").alias("queue_seconds"), seconds_between("started_at", "completed_at").alias("exec_seconds")


def hour_bucket(at: Column | str) -> Column:
    return F.date_format(F.date_trunc("hour", at), "yyyy-MM-dd HH:00")


def basename(path: Column | str) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def task_type(path: Column | str) -> Column:
    """cuda, cpp, c, header or other, by the file's extension."""
    e = extension(path)
    return F.when(e.isin(*CUDA), "cuda").when(e.isin(*CPP), "cpp").when(e.isin(*C), "c").when(e.isin(*HEADER), "header").otherwise("other")


def node_type(vertex_id: Column | str) -> Column:
    """The kind that an id's prefix names, or unknown."""
    prefix = F.substring_index(vertex_id, ":", 1)
    return F.when(prefix.isin("compile", "link", "gen"), prefix).otherwise("unknown")


def infer_module(path: Column, root: str) -> Column:
    """The folder below the root that holds a file; python and configuration probes have modules of their own."""
    below = F.substring(path, len(root) + 1, 2**31 - 1)
    return F.when(path.startswith(root), F.split_part(below, F.lit("/"), F.lit(1))).when(path.startswith("python/"), "python").when(path.startswith("build_compile_db/"), "cmake_probe").otherwise("other")


def file_phase(path: Column) -> Column:
    found = F.lit(3)
    for folder, phase in reversed(PHASES):
        found = F.when(path.contains(folder), phase).otherwise(found)
    return found


def is_generated(path: Column | str) -> Column:
    return F.col(path).rlike(GENERATED) if isinstance(path, str) else path.rlike(GENERATED)


def infer_generator(name: Column) -> Column:
    """The step that makes a generated file, from its name; null for others."""
    return (
        F.when(name.rlike(r"\.pb\.(cc|h)$"), F.concat(F.lit("gen:protoc:"), F.regexp_replace(name, r"\.pb\.(cc|h)$", ".proto")))
        .when(name.rlike(r"^moc_.*\.cpp$"), F.concat(F.lit("gen:moc:"), F.regexp_replace(name, r"^moc_(.*)\.cpp$", "$1.h")))
        .when(name.rlike(r"^ui_.*\.h$"), F.concat(F.lit("gen:uic:"), F.regexp_replace(name, r"^ui_(.*)\.h$", "$1.ui")))
        .when(name.rlike(r"\.tab\.[ch]$"), F.concat(F.lit("gen:bison:"), F.regexp_replace(name, r"\.tab\.[ch]$", ".y")))
    )


def is_cuda(path: Column | str, arguments: Column | str) -> Column:
    return (extension(path) == "cu") | F.exists(arguments, lambda a: F.lower(a).contains("nvcc"))


def classify_machine(cpu_percent: Column, memory_percent: Column) -> Column:
    """high, medium or low spare capacity, from loads in percent."""
    cpu, memory = cpu_percent / 100, memory_percent / 100
    return F.when((cpu < 0.5) & (memory < 0.6), "high").when((cpu < 0.7) & (memory < 0.8), "medium").otherwise("low")


def balance_grade(cv_percent: Column) -> Column:
    return F.when(cv_percent < 10, "excellent").when(cv_percent < 20, "good").otherwise("fair")


def source_features(text: Column) -> dict[str, Column]:
    """size_kb, code_lines (neither blank nor comment), includes, templates and their weighted complexity."""
    lines = F.split(text, "\n")
    code = F.size(F.filter(lines, lambda s: (F.trim(s) != "") & ~F.trim(s).startswith("//")))
    size_kb = F.octet_length(text) / 1024
    includes = F.regexp_count(text, F.lit(INCLUDE))
    templates = F.regexp_count(text, F.lit(r"template\s*<")) + F.regexp_count(text, F.lit(r"std::\w+<")) / 5
    return {"size_kb": size_kb, "code_lines": code, "includes": includes, "templates": templates, "complexity": size_kb * 0.4 + code / 10 * 0.3 + includes * 5.0 * 0.2 + templates * 10.0 * 0.1}


def estimate_compile_time(size_kb: Column, includes: Column, templates: Column) -> Column:
    """Seconds, linear in the size by pieces, with capped penalties for templates and includes."""
    base = None
    for start, seconds, rate in reversed(SIZE_PIECES):
        piece = seconds + (size_kb - start) * rate
        base = piece if base is None else F.when(size_kb < following, piece).otherwise(base)
        following = start
    return F.round(base + F.least(F.floor(templates) * 2.0, F.lit(30.0)) * 0.3 + F.least(includes * 0.5, F.lit(15.0)) * 0.2, 2)


def fallback_time(history: Column, size_kb: Column) -> Column:
    return F.coalesce(history, F.greatest(F.lit(0.1), size_kb * 0.001), F.lit(1.0))


def transfer_size_mb(size_bytes: Column) -> Column:
    return F.greatest(F.lit(0.01), size_bytes * 1.5 / (1024 * 1024))


def comm_cost(src_node: Column, dst_node: Column, latency_ms: Column, size_mb: Column, mb_per_second: Column) -> Column:
    """Seconds to move a result; none on one node; defaults of 1 ms and 100 MB/s."""
    return F.when(src_node == dst_node, 0.0).otherwise(F.coalesce(latency_ms, F.lit(1)) / 1000 + size_mb / F.coalesce(mb_per_second, F.lit(100.0)))


def performance_score(weight: Column, cpu: Column, load_ratio: Column, success: Column, latency_ms: Column) -> Column:
    """The static weight if positive, else how free, reliable and near the node is."""
    free = lambda used: F.greatest(F.lit(0.0), 1 - used)
    dynamic = 0.3 * free(cpu / 100) + 0.3 * free(load_ratio) + 0.3 * success + 0.1 * free(F.least(latency_ms / 1000, F.lit(1.0)))
    return F.when(weight > 0, weight).otherwise(dynamic)


def flag_values(arguments: Column, flag: str) -> Column:
    """What follows a flag, joined to it or as the next argument, in order."""
    found = F.transform(arguments, lambda a, i: F.when(a == flag, F.get(arguments, i + 1)).when(a.startswith(flag), F.substring(a, len(flag) + 1, 2**31 - 1)))
    return F.filter(found, lambda v: v.isNotNull())


def include_paths(arguments: Column) -> Column:
    return flag_values(arguments, "-I")


def dependency_flags(arguments: Column) -> Column:
    """Flags that bear on dependencies; one that stands alone takes the next argument along, behind a colon."""
    joined = "^(" + "|".join((*VALUE_FLAGS, *JOINED_FLAGS)) + ")."

    def flag(a: Column, i: Column) -> Column:
        taken = F.coalesce(F.when(i > 0, F.get(arguments, i - 1)), F.lit("")).isin(*VALUE_FLAGS)
        alone = a.isin(*VALUE_FLAGS) & F.get(arguments, i + 1).isNotNull()
        return F.when(~taken & alone, F.concat_ws(":", a, F.get(arguments, i + 1))).when(~taken & a.rlike(joined), a)

    return F.filter(F.transform(arguments, flag), lambda v: v.isNotNull())


def flag_signature(arguments: Column) -> Column:
    """Sixteen hexadecimal digits that name the sorted dependency flags."""
    return F.substring(F.md5(F.concat_ws("|", F.array_sort(dependency_flags(arguments)))), 1, 16)


def sanitize_flags(arguments: Column) -> Column:
    """Flags that a rebuild keeps; the value of -o and everything else goes."""
    return F.filter(arguments, lambda a, i: a.rlike("^(-I|-D|-std=|-O|-f|-W|-isystem)") & (F.coalesce(F.get(arguments, i - 1), F.lit("")) != "-o"))


def infer_output(output: Column, arguments: Column, file: Column, directory: Column) -> Column:
    """The output, else what follows -o, else the source with .o; made absolute."""
    at = F.array_position(arguments, "-o").cast("int")
    named = F.when(at > 0, F.get(arguments, at))
    path = F.coalesce(output, named, F.regexp_replace(file, r"\.[^./]+$", ".o"))
    return F.when(path.startswith("/"), path).otherwise(F.concat(directory, F.lit("/"), path))


def extract_includes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r'#include\s*["<]([^">\n]+)[">]'), F.lit(1))


def task_id_of(path: Column, root: str) -> Column:
    """compile:<path below root>; null outside it."""
    return F.when(path.startswith(f"{root}/"), F.concat(F.lit("compile:"), F.substring(path, len(root) + 2, 2**31 - 1)))


def content_hash(text: Column, *, whole_below: int = 65536, part: int = 4096) -> Column:
    """md5 of a short text, of a long one's first part, the part from its middle on, and its last part."""
    raw = F.encode(text, "UTF-8")
    n = F.octet_length(text)
    middle = (n / 2).cast("int") + 1
    parts = F.concat(F.substring(raw, F.lit(1), F.lit(part)), F.substring(raw, middle, F.lit(part)), F.substring(raw, n - part + 1, F.lit(part)))
    return F.when(n < whole_below, F.md5(raw)).otherwise(F.md5(parts))


def is_header_missing(stderr: Column) -> Column:
    return F.lower(stderr).rlike("no such file or directory|file not found") & F.lower(stderr).rlike(r"\.(h|hpp|hxx|inc)\b")


def missing_header(stderr: Column) -> Column:
    return F.nullif(F.regexp_extract(stderr, r"([\w./+-]+\.(?:h|hpp|hxx|inc)):? (?:No such file|file not found)", 1), F.lit(""))


def exec_node(line: Column) -> Column:
    """The host a client line says it runs on; a bare localhost is "local"."""
    host = F.nullif(F.regexp_extract(line, r"exec on ([\w.-]+(?::\d+)?)", 1), F.lit(""))
    return F.when(host == "localhost", "local").otherwise(host)


def log_event(line: Column) -> dict[str, Column]:
    """kind, task, node and seconds of a scheduler line; the first pattern that fits decides."""
    kinds = (("completed", r"Task \S+ completed in"), ("scheduled", r"Task \S+ scheduled to"), ("started", r"Task \S+ started"), ("failed", r"Task \S+ failed"), ("heartbeat", r"Heartbeat from"))
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(kinds):
        kind = F.when(line.rlike(pattern), name).otherwise(kind)
    found = lambda pattern: F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    return {"kind": kind, "task": found(r"Task (\S+) "), "node": found(r"(node\d+)"), "seconds": found(r"completed in ([\d.]+)s").cast("double")}


# The lines of a build session's log, in the order in which they are tried.
SESSION_LINES = (
    ("completed", r"CompilationTracker - INFO - .* Completed .* in ([0-9.]+)s"),
    ("assigned", r"Scheduled task ccdb_.* to node ([0-9.]+)"),
    ("scheduled", r"Task ccdb_([0-9]+) scheduled for execution"),
    ("started", r"Task ccdb_([0-9]+) started on node ([0-9.]+)"),
    ("failed", r"Task ccdb_([0-9]+) failed: (.*)"),
    ("summary", r"项目编译完成: (\{.*\})"),
)


def session_event(line: Column) -> dict[str, Column]:
    """kind, task, node, seconds and reason of a line of a session's log; what a kind does not tell, and all of other lines, is null."""
    pattern = dict(SESSION_LINES)
    kind = F.lit(None).cast("string")
    for name, form in reversed(SESSION_LINES):
        kind = F.when(line.rlike(form), name).otherwise(kind)
    part = lambda name, group: F.when(kind == name, F.regexp_extract(line, pattern[name], group))
    return {
        "kind": kind,
        "task": F.coalesce(*[part(name, 1) for name in ("scheduled", "started", "failed")]),
        "node": F.coalesce(part("assigned", 1), part("started", 2)),
        "seconds": part("completed", 1).try_cast("double"),
        "reason": F.nullif(F.trim(part("failed", 2)), F.lit("")),
    }


def nearest_rank(values: Column, percent: float) -> Column:
    """Percentile by nearest rank with half-even rounding, of an array of one group's values."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, (F.bround(percent / 100 * (F.size(ordered) - 1), 0) + 1).cast("int"))


def ema(pairs: Column, alpha: float) -> Column:
    """Exponential moving average over an array of structs (order, value), beginning at the first value; null of none."""
    values = F.transform(F.array_sort(pairs), lambda p: p["value"].cast("double"))
    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda acc, x: (1 - alpha) * acc + alpha * x)


def needs_generated_include(text: Column) -> Column:
    """Whether a text includes what a code generator makes."""
    return text.rlike(r'#include\s*["<](?:[^">]*/)?(?:moc_[^">]*\.cpp|[^">]*\.moc)[">]')


def is_remote_ok(path: Column, arguments: Column, capable: Column | None = None) -> Column:
    """Whether a unit may be compiled on another node: not marked otherwise, and not CUDA."""
    marked = F.lit(True) if capable is None else F.coalesce(capable, F.lit(True))
    return marked & ~is_cuda(path, arguments)


def needs_local_only(path: Column, fragments: tuple[str, ...] = LOCAL_ONLY) -> Column:
    return path.rlike("|".join(fragments))


def is_io_heavy(size: Column, path: Column, preprocessed: Column) -> Column:
    return (size > 500 * 1024) | extension(path).isin("tpp", "hpp", "hxx") | (F.coalesce(preprocessed, F.lit(0)) > 1024 * 1024)


def optimisation_level(arguments: Column) -> Column:
    """Level of the last -O flag; s and z count as 1.5, none as 0."""
    last = F.element_at(F.filter(arguments, lambda a: a.rlike("^-O[0-3sz]?$")), -1)
    flag = F.substring(last, 3, 1)
    return F.when(F.size(F.filter(arguments, lambda a: a.rlike("^-O[0-3sz]?$"))) == 0, 0.0).when(flag.isin("s", "z"), 1.5).when(flag == "", 1.0).otherwise(flag.cast("double"))


def compile_features(text: Column, preprocessed: Column, arguments: Column) -> Column:
    """preprocessed megabytes, includes, expansion, thousands of lines and level, each about one."""
    size = F.octet_length(text)
    whole = F.coalesce(preprocessed.cast("double"), size * 1.5)
    lines = F.size(F.split(text, "\n"))
    includes = F.regexp_count(text, F.lit(INCLUDE))
    return F.array(whole / 1_000_000, includes / 50, whole / F.greatest(size, F.lit(1)), lines / 1000, optimisation_level(arguments) / 3)


def combined_weight(weight: Column, speedup: Column) -> Column:
    return 0.7 * weight + 0.3 * F.coalesce(speedup, F.lit(1.0))


def extract_flags(arguments: Column) -> Column:
    """Compiler flags, joined with their values; the compiler, sources, outputs and dependency-file flags are left out."""
    valued = ("-I", "-isystem", "-D", "-U", "-include", "-x", "-std", "-arch")
    dropped = ("-c", "-E", "-o", "-MF", "-MD", "-MT", "-MMD", "-MP", "-MQ")
    taking = ("-o", "-MF", "-MT", "-MQ")

    def flag(a: Column, i: Column) -> Column:
        before = F.coalesce(F.when(i > 0, F.get(arguments, i - 1)), F.lit(""))
        keep = a.startswith("-") & ~a.isin(*dropped) & ~before.isin(*taking) & ~before.isin(*valued)
        return F.when(keep & a.isin(*valued), F.concat_ws(" ", a, F.get(arguments, i + 1))).when(keep, a)

    return F.filter(F.transform(arguments, flag), lambda f: f.isNotNull())


def summary_dict(line: Column) -> Column:
    """A dictionary as Python prints it, read as a map."""
    body = F.regexp_extract(line, r"(\{.*\})", 1)
    json = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "'", '"'), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    return F.from_json(F.regexp_replace(json, r"\bNone\b", "null"), "map<string,string>")
