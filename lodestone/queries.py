"""The library's own queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import binary
from .functions.instructions import category, complexity_level, split_text
from .operators import callgraph, cfg, detect, disasm, entropy, export, patterns, security, strings
from .operators import instructions as instr
from .operators import sections as sec
from .operators import symbols as sym
from .plans import bindings as b
from .plans import samples
from .sources import artifacts as artifacts_of
from .sources import parse as parsing
from .sources.artifacts import spread
from .streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def with_bytes(artifacts: DataFrame) -> DataFrame:
    """Artifacts that have content: bytes are described for these only."""
    return artifacts.where(F.col("length") > 0)


def r6(c: str, name: str | None = None):
    return F.round(c, 6).alias(name or c)


# Detection, bytes, entropy


@query
def entropy_packing_levels(spark, sf):
    p = entropy.packing(with_bytes(b.documents(spark, sf)))
    return p.groupBy("obfuscation_level").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("entropy"), 4).alias("entropy"), F.count_if("is_packed").alias("packed"))


@query
def artifact_entropy(spark, sf):
    return entropy.artifact_entropy(with_bytes(b.documents(spark, sf))).select("artifact_id", r6("entropy"))


@query
def page_entropy(spark, sf):
    return entropy.artifact_entropy(with_bytes(b.pages(spark, sf))).select("artifact_id", r6("entropy"))


@query
def byte_frequencies(spark, sf):
    return entropy.byte_frequencies(b.documents(spark, sf)).groupBy("byte").agg(F.sum("n").alias("n"))


@query
def byte_chi_square(spark, sf):
    return with_bytes(b.documents(spark, sf)).select("artifact_id", F.round(entropy.content_chi_square("content"), 4).alias("chi_square"))


@query
def chunk_entropy(spark, sf):
    return entropy.chunks(b.documents(spark, sf)).select("artifact_id", "chunk", "start", "end", r6("entropy"))


@query
def dense_regions(spark, sf):
    return entropy.high_entropy_regions(b.documents(spark, sf), threshold=4.5).select("artifact_id", "start", "end", r6("entropy"), "description")


@query
def packing_indicators(spark, sf):
    return entropy.packing(with_bytes(b.documents(spark, sf))).select("artifact_id", r6("entropy"), "is_packed", "packer_name", "compression_ratio", "obfuscation_level")


@query
def detect_formats(spark, sf):
    both = b.documents(spark, sf).unionByName(b.pages(spark, sf))
    return detect.detect(both).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


@query
def parser_predicates(spark, sf):
    tests = detect.can_parse()
    return b.documents(spark, sf).select("artifact_id", *[c.alias(f"is_{k.lower()}") for k, c in tests.items()])


@query
def byte_readers(spark, sf):
    c = "content"
    return b.documents(spark, sf).select(
        "artifact_id", binary.uint(c, 0, 1).alias("u8"), binary.uint(c, 1, 2).alias("u16"), binary.uint(c, 2, 4, "big").alias("u32"),
        binary.uint(c, F.length(c) - 2, 2, "big").alias("last16"), binary.uint(c, 60, 4).alias("u32_60"),
    )


@query
def byte_views(spark, sf):
    c = "content"
    return b.documents(spark, sf).select(
        "artifact_id", F.hex(binary.view(c, 3, 8)).alias("view"), binary.cstring(c, 0, 1 << 30).alias("text"), binary.starts_with(c, b"Th").alias("starts"),
        binary.contains(c, b" of ").alias("holds"),
    )


@query
def hexdumps(spark, sf):
    return with_bytes(b.documents(spark, sf)).select("artifact_id", binary.hexdump("content").alias("dump"))


@query
def parsed_metadata(spark, sf):
    p = parsing.parse(b.documents(spark, sf), fallback="Raw")
    return parsing.metadata(p).select("artifact_id", "error", "size", "format", "architecture", "entry_point", "base_address", "compiler_info", "endian", "nx_bit", "pie")


@query
def parsed_sections(spark, sf):
    s = parsing.children(parsing.parse(b.documents(spark, sf), fallback="Raw"), "sections")
    return s.select("artifact_id", "ordinal", "name", "address", "size", "offset", "perm_read", "perm_write", "perm_execute", "section_type", F.length("data").alias("inline"))


@query
def section_entropy(spark, sf):
    docs = b.documents(spark, sf)
    half = docs.select("artifact_id", F.posexplode(F.array(F.lit("head"), F.lit("body"), F.lit("head"))).alias("ordinal", "name"), F.col("length").alias("n"))
    sections = half.select("artifact_id", "ordinal", "name", F.when(F.col("ordinal") == 0, 0).when(F.col("ordinal") == 1, 100).otherwise(50).cast("long").alias("offset"), F.when(F.col("ordinal") == 1, F.col("n") - 100).otherwise(200).alias("size"))
    return entropy.section_entropy(docs, sections).select("artifact_id", "name", r6("entropy"))


# Binaries of every format (plans.samples)


def _binaries(spark, sf):
    return parsing.parse(spread(samples.binaries(spark, sf)))


@query
def binary_formats(spark, sf):
    return detect.detect(samples.binaries(spark, sf)).groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("errors"))


@query
def binary_predicates(spark, sf):
    return samples.binaries(spark, sf).select("artifact_id", *[c.alias(f"is_{k.lower()}") for k, c in detect.can_parse().items()])


@query
def binary_metadata(spark, sf):
    m = parsing.metadata(_binaries(spark, sf))
    own = ("format", "architecture", "entry_point", "base_address", "timestamp", "compiler_info", "endian", *parsing.FEATURES)
    return m.select("artifact_id", F.col("error").isNotNull().alias("failed"), *own)


@query
def binary_sections(spark, sf):
    s = parsing.children(_binaries(spark, sf), "sections")
    return s.select("artifact_id", "ordinal", "name", "address", "size", "offset", "perm_read", "perm_write", "perm_execute", "section_type", F.length("data").alias("inline"))


@query
def binary_symbols(spark, sf):
    return parsing.children(_binaries(spark, sf), "symbols")


@query
def binary_imports(spark, sf):
    return parsing.children(_binaries(spark, sf), "imports")


@query
def binary_exports(spark, sf):
    return parsing.children(_binaries(spark, sf), "exports").select("artifact_id", "ordinal", "name", "address", "forwarded_name")


@query
def binary_code(spark, sf):
    """Instructions of the executable sections whose architecture is x86."""
    p = _binaries(spark, sf)
    code = disasm.section_code(parsing.metadata(p), parsing.children(p, "sections")).where(F.col("architecture").isin("X86", "X86_64"))
    return disasm.disassemble(code).select("artifact_id", "function_addr", "idx", "address", F.hex("bytes").alias("bytes"), "mnemonic", "operands", "flow_kind", "flow_target", "size", "category")


@query
def binary_demangled(spark, sf):
    s = sym.demangle_symbols(parsing.children(_binaries(spark, sf), "symbols"), placeholders=False)
    return s.groupBy("name", "demangled_name").agg(F.count(F.lit(1)).alias("n"))


# Patterns and strings

PATTERNS = (
    patterns.Pattern("the", "bytes", b"the", "Crypto"),
    patterns.Pattern("of", "string", " of ", "Api"),
    patterns.Pattern("wild", "hex", "74 68 ?? 20", "Malware"),
    patterns.Pattern("head", "magic", b"Th", "FileFormat"),
    patterns.Pattern("short", "bytes", b"th", "Api"),
)


@query
def pattern_matches(spark, sf):
    m = patterns.search(b.documents(spark, sf), PATTERNS)
    return m.select("artifact_id", "pattern_idx", "name", "category", "offset", "length", F.hex("data").alias("data"))


@query
def pattern_categories(spark, sf):
    m = patterns.search(b.documents(spark, sf), PATTERNS, patterns.MatchConfig(max_matches=None))
    return m.groupBy("category", "name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("artifact_id").alias("artifacts"), F.sum("offset").alias("offsets"))


@query
def builtin_patterns(spark, sf):
    m = patterns.search(b.pages(spark, sf), patterns.builtin())
    return m.groupBy("name", "category").agg(F.count(F.lit(1)).alias("n"))


@query
def top_pattern_categories(spark, sf):
    return patterns.top_categories(patterns.search(b.documents(spark, sf), PATTERNS, patterns.MatchConfig(max_matches=None)))


@query
def folded_matches(spark, sf):
    """Strings without regard to case, letters beyond ASCII too."""
    words = (patterns.Pattern("é", "string", "É", "Api"), patterns.Pattern("ung", "string", "UNG ", "Api"))
    m = patterns.search(b.documents(spark, sf), words, patterns.MatchConfig(case_sensitive=False, max_matches=None, min_length=1))
    return m.groupBy("artifact_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query
def builtin_binary_patterns(spark, sf):
    m = patterns.search(samples.binaries(spark, sf), patterns.builtin())
    return m.groupBy("name", "category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("artifact_id").alias("artifacts"))


@query
def matches_by_category(spark, sf):
    m = patterns.by_category(patterns.search(samples.binaries(spark, sf), patterns.builtin()))
    return m.select("artifact_id", "category", F.array_join(F.transform("matches", lambda x: x["name"]), ",").alias("names"))


@query
def described_regions(spark, sf):
    return entropy.high_entropy_regions(samples.dense_chunks(spark, sf), threshold=5.0).select("artifact_id", "start", "end", "description")


@query
def inflated_samples(spark, sf):
    s = samples.compressed(spark, sf).select("artifact_id", artifacts_of.decompressed("content").alias("x"))
    return s.select("artifact_id", F.length("x.data").alias("length"), F.col("x.error").isNotNull().alias("failed"))


@query
def overlapping_counts(spark, sf):
    c = "content"
    counts = {"the": binary.count_overlapping(c, binary.regex_of(b"the")), "wild": binary.count_overlapping(c, "\\x74\\x68.\\x20")}
    return b.documents(spark, sf).select("artifact_id", *[F.coalesce(n, F.lit(0)).alias(k) for k, n in counts.items()])


@query
def printable_strings(spark, sf):
    return strings.printable(b.documents(spark, sf), 12)


@query
def string_indicators(spark, sf):
    return strings.indicators(b.documents(spark, sf).unionByName(b.pages(spark, sf).withColumn("artifact_id", F.concat(F.lit("p"), "artifact_id"))), ("url", "email"))


# Security


@query
def security_findings(spark, sf):
    return security.findings(b.imports(spark, sf), b.sections(spark, sf), b.symbols(spark, sf), b.features(spark, sf))


@query
def security_severities(spark, sf):
    f = security.findings(b.imports(spark, sf), b.sections(spark, sf), b.symbols(spark, sf), b.features(spark, sf))
    return security.findings_by_severity(f)


@query
def security_indicators(spark, sf):
    return security.indicators(b.imports(spark, sf))


@query
def risk_scores(spark, sf):
    # A user's events at a time, so that scores differ.
    one = lambda df: df.where(F.col("ordinal") >= 0).withColumn("artifact_id", F.concat("artifact_id", F.lit("/"), F.floor(F.col("ordinal") / 97)))
    imports, sections, symbols = one(b.imports(spark, sf)), one(b.sections(spark, sf)), one(b.symbols(spark, sf))
    feats = imports.select("artifact_id").distinct().withColumn("key", F.substring_index("artifact_id", "/", 1)).join(b.features(spark, sf).withColumnRenamed("artifact_id", "key"), "key").drop("key")
    scores = security.risk_scores(imports, security.findings(imports, sections, symbols, feats), feats)
    return scores.select("artifact_id", "risk", security.risk_level("risk").alias("level"))


# Instructions and control flow


@query
def instruction_classes(spark, sf):
    i = instr.classified(b.instructions(spark, sf))
    return i.groupBy("mnemonic", "category", "flow_kind").agg(F.count(F.lit(1)).alias("n"), F.sum("flow_target").alias("targets"))


@query
def category_shares(spark, sf):
    return instr.shares(instr.classified(b.instructions(spark, sf)), "category").select("category", "n", r6("percent"))


@query
def top_mnemonics(spark, sf):
    return instr.most_frequent(b.instructions(spark, sf), "mnemonic", 10)


@query
def instruction_totals(spark, sf):
    return instr.totals(b.instructions(spark, sf))


@query
def capped_instructions(spark, sf):
    i = instr.capped(b.instructions(spark, sf), 20)
    return i.groupBy("function_addr").agg(F.count(F.lit(1)).alias("n"), F.max("idx").cast("long").alias("last"))


@query
def split_instructions(spark, sf):
    i = b.instructions(spark, sf)
    parts = split_text(F.concat(F.lit(" "), "mnemonic", F.lit(" "), "operands"))
    return i.groupBy(parts["mnemonic"].alias("mnemonic"), parts["operands"].alias("operands")).agg(F.count(F.lit(1)).alias("n"))


@query
def basic_blocks(spark, sf):
    return cfg.blocks(cfg.with_blocks(b.instructions(spark, sf)))


@query
def cfg_edges(spark, sf):
    return cfg.edges(cfg.blocks(cfg.with_blocks(b.instructions(spark, sf))))


def _graph(spark, sf):
    blocked = cfg.with_blocks(b.instructions(spark, sf))
    rows = cfg.blocks(blocked)
    return blocked, cfg.graph(rows, cfg.edges(rows))


@query
def block_types(spark, sf):
    _, g = _graph(spark, sf)
    return g.select("artifact_id", "function_addr", "block", "block_type", F.size("successors").alias("out_edges"), F.size("predecessors").alias("in_edges"))


@query
def function_complexity(spark, sf):
    m = cfg.complexity(*_graph(spark, sf))
    return m.select("artifact_id", "function_addr", "block_count", "edge_count", "cyclomatic", "nesting_depth", "cognitive", complexity_level("cyclomatic").alias("level"), r6("maintainability"))


@query
def halstead_metrics(spark, sf):
    h = cfg.halstead(b.instructions(spark, sf))
    return h.select("artifact_id", "function_addr", "n1", "n2", "vocabulary", "length", r6("calculated_length"), r6("volume"), r6("difficulty"), F.round("effort", 3).alias("effort"), r6("bugs"))


@query
def cognitive_summary(spark, sf):
    s = cfg.cognitive_summary(cfg.complexity(*_graph(spark, sf)))
    return s.select("artifact_id", "total", r6("average"), "most", "most_complex", "functions")


@query
def top_functions(spark, sf):
    m = cfg.complexity(*_graph(spark, sf))
    return m.orderBy(F.desc("cyclomatic"), "function_addr").limit(5).select("function_addr", "cyclomatic", "block_count")


@query
def natural_loops(spark, sf):
    blocked, g = _graph(spark, sf)
    return cfg.loops(g, blocked)


@query
def loop_summary(spark, sf):
    blocked, g = _graph(spark, sf)
    return cfg.loop_summary(cfg.loops(g, blocked)).withColumn("by_type", F.to_json("by_type"))


@query
def dominator_tree(spark, sf):
    return cfg.dominator_tree(_graph(spark, sf)[1])


@query
def cfg_dot(spark, sf):
    rows = cfg.blocks(cfg.with_blocks(b.instructions(spark, sf)))
    return export.cfg_dot(rows, cfg.edges(rows))


@query
def decoded_instructions(spark, sf):
    """Texts read as x86-64 code."""
    docs = spread(b.documents(spark, sf))
    code = docs.select("artifact_id", F.lit(0).cast("long").alias("function_addr"), F.lit("X86_64").alias("architecture"), F.lit(0).cast("long").alias("address"), F.col("content").alias("data"))
    found = disasm.disassemble(code, most=1 << 30, columns=["mnemonic", "flow_kind", "size"]).groupBy("mnemonic", "flow_kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return found.select("mnemonic", category("mnemonic").alias("category"), "flow_kind", "n", "bytes")


# Sections, symbols, comparisons


@query
def located_points(spark, sf):
    points = b.symbols(spark, sf).select("artifact_id", (F.col("ordinal") * 64 + 32).alias("point"))
    return sec.locate(points, b.sections(spark, sf), "point").select("artifact_id", "point", "ordinal", "section")


@query
def first_text_sections(spark, sf):
    return sec.section_named(b.sections(spark, sf), ".text").select("artifact_id", "ordinal", "address", "size")


@query
def call_graph_functions(spark, sf):
    entries = b.features(spark, sf).select("artifact_id", (F.col("artifact_id").cast("long") + 100000).alias("entry_point"))
    return sec.call_graph_functions(b.symbols(spark, sf), entries).select("artifact_id", "start", F.col("ordinal").cast("long").alias("ordinal"), "name", F.col("size").cast("long").alias("size"))


@query
def imports_by_library(spark, sf):
    return sec.imports_by_library(b.imports(spark, sf)).select("artifact_id", "library", "n", F.array_join("names", ",").alias("names"))


@query
def nation_diff(spark, sf):
    one = b.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    two = b.table(spark, sf, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return sec.diff(one, two, ["key"], ["n"]).select("key", "status", F.col("old.n").alias("old"), F.col("new.n").alias("new"))


@query
def library_functions(spark, sf):
    return b.symbols(spark, sf).groupBy("name", callgraph.is_library("name").alias("is_library"), sym.demangled("name").alias("demangled")).agg(F.count(F.lit(1)).alias("n"))


# Call graphs


def _calls(spark, sf):
    return b.call_nodes(spark, sf), b.call_edges(spark, sf), b.call_entries(spark, sf)


@query
def call_degrees(spark, sf):
    nodes, edges, _ = _calls(spark, sf)
    return callgraph.degrees(nodes, edges)


@query
def call_node_types(spark, sf):
    nodes, _, entries = _calls(spark, sf)
    outside = nodes.where(F.pmod("address", F.lit(3)) == 0).select("artifact_id", "address")
    return callgraph.node_types(nodes, outside, entries).select("address", "name", "node_type")


@query
def call_depths(spark, sf):
    _, edges, entries = _calls(spark, sf)
    return callgraph.depths(edges, entries).select("address", "depth")


@query
def recursive_functions(spark, sf):
    nodes, edges, _ = _calls(spark, sf)
    return callgraph.recursive(nodes, edges)


@query
def unreachable_functions(spark, sf):
    nodes, edges, entries = _calls(spark, sf)
    return callgraph.unreachable(nodes, callgraph.depths(edges, entries)).select("address", "name")


@query
def program_unreachable(spark, sf):
    """Functions of many programs that their least function does not reach."""
    nodes, edges = b.program_calls(spark, sf)
    entries = nodes.groupBy("artifact_id").agg(F.min("address").alias("address"))
    return callgraph.unreachable(nodes, callgraph.depths(edges, entries)).select("artifact_id", "address")


@query
def kept_call_nodes(spark, sf):
    nodes, edges, _ = _calls(spark, sf)
    return callgraph.kept_nodes(nodes, 20).select("artifact_id", "address", "name")


@query
def call_statistics(spark, sf):
    nodes, edges, entries = _calls(spark, sf)
    s = callgraph.statistics(callgraph.annotated(nodes, edges, entries), edges, entries)
    return s.withColumn("avg_depth", F.round("avg_depth", 6))


@query
def instruction_calls(spark, sf):
    i = b.instructions(spark, sf)
    nodes = i.groupBy("artifact_id", (F.col("idx") * 4).cast("long").alias("address")).agg(F.count(F.lit(1)).alias("n"))
    return callgraph.call_edges(i, nodes).unionByName(callgraph.tail_calls(i, nodes)).groupBy("call_type", "callee").agg(F.count(F.lit(1)).alias("n"))


@query
def call_cycles(spark, sf):
    return callgraph.cycles(*b.program_calls(spark, sf))


@query
def call_graph_dot(spark, sf):
    nodes, edges, entries = _calls(spark, sf)
    typed = callgraph.node_types(nodes, nodes.limit(0).select("artifact_id", "address"), entries)
    return export.call_graph_dot(typed, edges, counts=True)


@query
def call_graph_json(spark, sf):
    nodes, edges, _ = _calls(spark, sf)
    return export.call_graph_json(nodes, edges)


# Exports and streams


@query
def metadata_json(spark, sf):
    docs = b.documents(spark, sf).select("artifact_id", "length")
    text = export.to_json(docs)
    back = export.from_json(text, "artifact_id string, length long").withColumnRenamed("length", "read_length")
    return text.join(back, "artifact_id")


@query
def hourly_events(spark, sf):
    w = streams.windowed_counts(b.table(spark, sf, "events"))
    return w.select(F.col("window.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def user_sessions(spark, sf):
    s = streams.sessions(b.table(spark, sf, "events"))
    return s.select("user_id", F.col("session_window.start").alias("started"), "n")


@query
def artifact_triage(spark, sf):
    return streams.triage(with_bytes(b.pages(spark, sf))).select("artifact_id", "format", "length", r6("entropy"), "level", "packer_name")
