"""The whole analysis of artifacts, as lazy frames that share one parse and one disassembly."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import callgraph, cfg, disasm, entropy, instructions, security, symbols
from ..operators import sections as sections_of
from ..operators.security import SecurityConfig
from ..sources import parse as parsing


@dataclass(frozen=True)
class AnalysisConfig:
    """max_analysis_size bounds instructions (a sixteenth of it); inline_limit the sections that carry their bytes."""

    max_analysis_size: int = 100 * 1024 * 1024
    inline_limit: int = 1024
    demangle_placeholders: bool = True
    exact_dominators: bool = False
    indirect_calls: bool = True
    detect_tail_calls: bool = True
    security: SecurityConfig = field(default_factory=SecurityConfig)


class Analysis:
    """Frames of an analysis; what is not asked for is not computed.

    Parsed rows, instructions, blocks and graphs are kept in memory and on disk until close(), or
    the end of a with statement.
    """

    def __init__(self, artifacts: DataFrame, config: AnalysisConfig | None = None) -> None:
        self.artifacts, self.config = artifacts, config or AnalysisConfig()
        self._kept: list[DataFrame] = []

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self._kept[-1]

    def close(self) -> None:
        """Gives back what is kept; frames can still be used and are computed anew."""
        while self._kept:
            self._kept.pop().unpersist()

    def __enter__(self) -> Analysis:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @cached_property
    def parsed(self) -> DataFrame:
        return self._keep(parsing.parse(self.artifacts, self.config.inline_limit))

    @cached_property
    def metadata(self) -> DataFrame:
        return parsing.metadata(self.parsed)

    @cached_property
    def sections(self) -> DataFrame:
        return parsing.children(self.parsed, "sections")

    @cached_property
    def symbols(self) -> DataFrame:
        return symbols.demangle_symbols(parsing.children(self.parsed, "symbols"), self.config.demangle_placeholders)

    @cached_property
    def imports(self) -> DataFrame:
        return parsing.children(self.parsed, "imports")

    @cached_property
    def exports(self) -> DataFrame:
        return parsing.children(self.parsed, "exports")

    @cached_property
    def functions(self) -> DataFrame:
        """Function symbols, or the entry point as _start of 1,000 bytes where an artifact has none."""
        own = sections_of.function_symbols(self.symbols).select("artifact_id", F.col("address").alias("start"), "name", "size")
        entry = self.metadata.where("entry_point is not null").select("artifact_id", F.col("entry_point").alias("start"), F.lit("_start").alias("name"), F.lit(1000).cast("long").alias("size"))
        return own.unionByName(entry.join(own.select("artifact_id").distinct(), "artifact_id", "left_anti"))

    @cached_property
    def disassembly(self) -> DataFrame:
        return disasm.disassemble(disasm.section_code(self.metadata, self.sections), self.config.max_analysis_size // 16)

    @cached_property
    def function_instructions(self) -> DataFrame:
        code = disasm.function_code(self.metadata, self.sections, self.functions.select("artifact_id", "start", "size").distinct())
        return self._keep(disasm.disassemble(code).where("mnemonic is not null"))

    @cached_property
    def blocked(self) -> DataFrame:
        return self._keep(cfg.with_blocks(self.function_instructions))

    @cached_property
    def cfg(self) -> DataFrame:
        rows = cfg.blocks(self.blocked)
        return self._keep(cfg.graph(rows, cfg.edges(rows)))

    @cached_property
    def complexity(self) -> DataFrame:
        return cfg.complexity(self.blocked, self.cfg)

    @cached_property
    def loops(self) -> DataFrame:
        return cfg.loops(self.cfg, self.blocked)

    @cached_property
    def dominators(self) -> DataFrame:
        return cfg.dominator_tree(self.cfg, self.config.exact_dominators)

    @cached_property
    def entries(self) -> DataFrame:
        return self.metadata.where("entry_point is not null").select("artifact_id", F.col("entry_point").alias("address"))

    @cached_property
    def call_nodes(self) -> DataFrame:
        known = sections_of.call_graph_functions(self.symbols, self.metadata.select("artifact_id", "entry_point"))
        nodes = known.select("artifact_id", F.col("start").alias("address"), "name", "size")
        return callgraph.node_types(nodes, self.imports.select("artifact_id", "address"), self.entries)

    @cached_property
    def call_edges(self) -> DataFrame:
        edges = callgraph.call_edges(self.function_instructions, self.call_nodes, self.config.indirect_calls)
        return edges.unionByName(callgraph.tail_calls(self.function_instructions, self.call_nodes)) if self.config.detect_tail_calls else edges

    @cached_property
    def call_graph(self) -> DataFrame:
        return callgraph.annotated(self.call_nodes, self.call_edges, self.entries)

    @cached_property
    def call_statistics(self) -> DataFrame:
        return callgraph.statistics(self.call_graph, self.call_edges, self.entries)

    @cached_property
    def function_report(self) -> DataFrame:
        """Functions with their complexity and their place in the call graph."""
        measures = self.complexity.withColumnRenamed("function_addr", "start")
        calls = self.call_graph.select("artifact_id", F.col("address").alias("start"), "node_type", "in_degree", "out_degree", "is_recursive", "depth")
        return self.functions.join(measures, ["artifact_id", "start"], "left").join(calls, ["artifact_id", "start"], "left")

    @cached_property
    def section_entropy(self) -> DataFrame:
        return entropy.section_entropy(self.artifacts, self.sections)

    @cached_property
    def packing(self) -> DataFrame:
        return entropy.packing(self.artifacts, self.section_entropy)

    @cached_property
    def regions(self) -> DataFrame:
        return entropy.high_entropy_regions(self.artifacts)

    @cached_property
    def findings(self) -> DataFrame:
        return security.findings(self.imports, self.sections, self.symbols, self._parsed_only, self.config.security)

    @cached_property
    def risk(self) -> DataFrame:
        scores = security.risk_scores(self.imports, self.findings, self._parsed_only, self.config.security)
        return scores.withColumn("level", security.risk_level("risk"))

    @cached_property
    def _parsed_only(self) -> DataFrame:
        return self.metadata.where("error is null")

    def instruction_totals(self) -> DataFrame:
        return instructions.totals(self.disassembly.where("mnemonic is not null"))
