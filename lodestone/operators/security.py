"""Security findings and risk scores by rules over imports, sections, symbols and features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import address

#: Severities in rising order, and what a finding of each adds to the score.
SEVERITIES = ("Info", "Low", "Medium", "High", "Critical")
SEVERITY_SCORE = {"Info": 0.5, "Low": 2.0, "Medium": 5.0, "High": 10.0, "Critical": 20.0}

#: Fixed values: (list, weight of an indicator, category of the finding, severity, text, names).
API_LISTS = (
    ("suspicious", 10.0, "SuspiciousApi", "High", "Suspicious API call", (
        "VirtualAllocEx", "WriteProcessMemory", "CreateRemoteThread", "SetWindowsHookEx", "NtMapViewOfSection", "ZwMapViewOfSection", "OpenProcess",
        "TerminateProcess", "SuspendThread", "ResumeThread", "AdjustTokenPrivileges", "LookupPrivilegeValue", "SeDebugPrivilege")),
    ("anti_debug", 5.0, "AntiDebug", "Medium", "Anti-debugging API", (
        "IsDebuggerPresent", "CheckRemoteDebuggerPresent", "NtQueryInformationProcess", "ZwQueryInformationProcess", "OutputDebugString", "GetTickCount",
        "QueryPerformanceCounter", "ptrace")),
    ("anti_vm", 5.0, "AntiVm", "Medium", "Anti-VM API", (
        "GetSystemInfo", "GlobalMemoryStatusEx", "GetAdaptersInfo", "GetVolumeInformation", "RegOpenKeyEx", "CreateToolhelp32Snapshot")),
    ("crypto", 1.0, "Cryptographic", "Info", "Cryptographic API", (
        "CryptAcquireContext", "CryptCreateHash", "CryptEncrypt", "CryptDecrypt", "CryptImportKey", "CryptExportKey")),
    ("network", 2.0, "Network", "Low", "Network API", (
        "WSAStartup", "socket", "connect", "send", "recv", "InternetOpen", "InternetOpenUrl", "HttpSendRequest")),
    ("filesystem", 1.0, "Filesystem", "Low", "Filesystem API", (
        "CreateFile", "WriteFile", "ReadFile", "DeleteFile", "MoveFile", "CopyFile", "FindFirstFile", "FindNextFile")),
    ("registry", 1.0, "Registry", "Low", "Registry API", (
        "RegOpenKeyEx", "RegCreateKeyEx", "RegSetValueEx", "RegQueryValueEx", "RegDeleteKey", "RegDeleteValue")),
)
#: Parts of section names; one has a capital letter and names are lower-cased, so it never matches.
SECTION_TOKENS = (".packed", ".upx", ".themida", ".aspack", ".pecompact", ".enigma", ".vmprotect", ".obsidium", ".tElock", ".shell", ".stub", ".overlay")
#: Parts of symbol names.
SYMBOL_TOKENS = ("bypass", "inject", "hook", "shellcode", "payload", "exploit", "backdoor", "rootkit", "keylog", "stealth")
#: Feature column, severity and text of its absence (none: it adds to the score alone), score.
FEATURES = (
    ("nx_bit", "Medium", "NX/DEP bit not enabled", 10.0),
    ("aslr", "Medium", "ASLR not enabled", 10.0),
    ("stack_canary", "Low", "Stack canaries not detected", 5.0),
    ("cfi", "Low", "Control Flow Integrity not enabled", 5.0),
    ("pie", None, None, 5.0),
)


@dataclass(frozen=True)
class SecurityConfig:
    """detect_suspicious_apis gates every check of imports."""

    detect_suspicious_apis: bool = True


def severity_rank(severity: Column | str) -> Column:
    """0 for Info to 4 for Critical."""
    s = F.col(severity) if isinstance(severity, str) else severity
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), s) - 1


def contains_any(name: Column, tokens: tuple[str, ...]) -> Column:
    """Whether the lower-cased name holds one of the tokens."""
    out = F.lit(False)
    for t in tokens:
        out = out | F.contains(F.lower(name), F.lit(t))
    return out


def api_rules(spark: SparkSession) -> DataFrame:
    """list, weight, category, severity, text and api: some 50 rows."""
    rows = [(k, w, c, s, t, api) for k, w, c, s, t, names in API_LISTS for api in names]
    return spark.createDataFrame(rows, "list string, weight double, category string, severity string, text string, api string")


def import_hits(imports: DataFrame) -> DataFrame:
    """Imports (artifact_id, ordinal, name, library) with the rules that name them, exactly; one may meet several."""
    rules = F.broadcast(api_rules(imports.sparkSession))  # a fixed list
    return imports.join(rules, imports["name"] == rules["api"])


def indicators(imports: DataFrame) -> DataFrame:
    """artifact_id, list and the names found, in the imports' order."""
    return import_hits(imports).groupBy("artifact_id", "list").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]).alias("names"))


def findings(imports: DataFrame, sections: DataFrame, symbols: DataFrame, features: DataFrame, config: SecurityConfig | None = None) -> DataFrame:
    """artifact_id, stage, ordinal, category, severity, description, location and data.

    Stages in order: 0 imports, 1 sections, 2 symbols, 3 features. Sections: artifact_id, ordinal,
    name, address, perm_write, perm_execute. Symbols: artifact_id, ordinal, name, address.
    Features: artifact_id and the columns of FEATURES.
    """
    config = config or SecurityConfig()
    none = F.lit(None).cast("string")

    def row(df: DataFrame, stage: int, category: Column, severity: Column, text: Column, location: Column, data: Column) -> DataFrame:
        return df.select(
            "artifact_id", F.lit(stage).alias("stage"), F.col("ordinal").cast("long").alias("ordinal"), category.alias("category"),
            severity.alias("severity"), text.alias("description"), location.alias("location"), data.alias("data"),
        )

    hits = import_hits(imports if config.detect_suspicious_apis else imports.where(F.lit(False)))
    out = row(hits, 0, F.col("category"), F.col("severity"), F.concat("text", F.lit(": "), "name"), F.col("library"), F.col("name"))
    rwx = sections.where(F.col("perm_write") & F.col("perm_execute"))
    out = out.unionByName(row(rwx, 1, F.lit("CodeInjection"), F.lit("High"), F.concat(F.lit("Section '"), "name", F.lit("' is both executable and writable (RWX)")), address("address"), F.col("name")))
    odd = sections.where(contains_any(F.col("name"), SECTION_TOKENS))
    out = out.unionByName(row(odd, 1, F.lit("Obfuscation"), F.lit("Medium"), F.concat(F.lit("Suspicious section name: "), "name"), address("address"), F.col("name")))
    named = symbols.where(contains_any(F.col("name"), SYMBOL_TOKENS))
    out = out.unionByName(row(named, 2, F.lit("SuspiciousApi"), F.lit("Medium"), F.concat(F.lit("Suspicious symbol: "), "name"), address("address"), F.col("name")))
    absent = F.array(*[F.when(~F.col(c), F.struct(F.lit(i).alias("ordinal"), F.lit(s).alias("severity"), F.lit(t).alias("text"))) for i, (c, s, t, _) in enumerate(FEATURES) if s])
    missing = features.select("artifact_id", F.explode(F.filter(absent, lambda x: x.isNotNull())).alias("m")).select("artifact_id", "m.*")
    return out.unionByName(row(missing, 3, F.lit("MissingSecurity"), F.col("severity"), F.col("text"), none, none))


def risk_scores(imports: DataFrame, found: DataFrame, features: DataFrame, config: SecurityConfig | None = None) -> DataFrame:
    """artifact_id and risk: half the sum of indicators, findings and missing features, 100 at most.

    An import counts as an indicator and as a finding.
    """
    config = config or SecurityConfig()
    hits = import_hits(imports if config.detect_suspicious_apis else imports.where(F.lit(False)))
    score = F.lit(0.0)
    for s, n in SEVERITY_SCORE.items():
        score = F.when(F.col("severity") == s, n).otherwise(score)
    lacking = F.lit(0.0)
    for column, _, _, n in FEATURES:
        lacking = lacking + F.when(F.col(column), 0.0).otherwise(n)
    parts = hits.select("artifact_id", F.col("weight").alias("points")).unionByName(found.select("artifact_id", score.alias("points"))).unionByName(features.select("artifact_id", lacking.alias("points")))
    total = parts.groupBy("artifact_id").agg(F.sum("points").alias("points"))
    return total.select("artifact_id", F.least(F.lit(100.0), F.col("points") / 2).alias("risk"))


def risk_level(risk: Column | str) -> Column:
    r = F.col(risk) if isinstance(risk, str) else risk
    return F.when(r <= 25, "Low").when(r <= 50, "Medium").when(r <= 75, "High").otherwise("Critical")


def findings_by_severity(found: DataFrame) -> DataFrame:
    """severity, rank and n, the gravest first."""
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", severity_rank("severity")).orderBy(F.desc("rank"))
