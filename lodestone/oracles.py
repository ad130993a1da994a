"""DuckDB SQL for the queries of queries.py that SQL can express."""

from __future__ import annotations

from .operators.callgraph import ENTRY_NAMES, LIBRARY_NAMES, LIBRARY_PREFIXES
from .operators.cfg import CONDITIONS, LOOPS, TRAPS
from .operators.security import API_LISTS, FEATURES, SECTION_TOKENS, SEVERITIES, SEVERITY_SCORE, SYMBOL_TOKENS
from .plans.bindings import APIS, MNEMONICS, SECTION_NAMES, SYMBOL_NAMES

#: Expected categories, independent of the expressions under test.
CATEGORY = {
    "mov": "Memory", "add": "Arithmetic", "jne": "Control", "call": "Control", "ret": "Control", "jmp": "Control", "imul": "Unknown", "vaesenc": "Crypto",
    "addps": "Arithmetic", "popcnt": "Memory", "syscall": "System", "loop": "Unknown", "lea": "Memory", "int": "System", "xor": "Logic", "je": "Control",
    "fadd": "Float", "vmovaps": "Vector", "nop": "Unknown", "cmp": "Unknown",
}


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _map(pairs: dict[str, object], of: str) -> str:
    return f"case {of} " + " ".join(f"when '{k}' then " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in pairs.items()) + " end"


DOCS = "docs as (select doc_id::varchar as artifact_id, text, hex(encode(text)) as hx from documents)"
BYTES = "bytes as (select artifact_id, unnest(regexp_extract_all(hx, '..')) as h, generate_subscripts(regexp_extract_all(hx, '..'), 1) - 1 as pos from docs)"
PAGE_BYTES = "bytes as (select page_id::varchar as artifact_id, unnest(regexp_extract_all(hex(encode(html)), '..')) as h from pages)"


def _entropy(key: str, source: str = "bytes", where: str = "true") -> str:
    """A query of key and entropy over rows with the column h."""
    return f"""select {key}, abs(coalesce(sum(-(n / total) * log2(n / total)), 0)) as entropy from (
        select {key}, n::double as n, sum(n) over (partition by {key})::double as total from (select {key}, h, count(*) as n from {source} where {where} group by all)) group by all"""


WHOLE = f"whole as ({_entropy('artifact_id')})"
LEVEL = "case when entropy > 7.8 then 'High' when entropy > 7.5 then 'Medium' when entropy > 7.0 then 'Low' else 'None' end"
PACKER = "case when strlen(hx) < 2048 then null " + " ".join(f"when contains(substr(hx, 1, 2048), '{n.encode().hex().upper()}') then '{n}'" for n in ("UPX", "VMProtect", "Themida", "ASPack")) + " end"
CHUNKS = "chunked as (select artifact_id, pos // 1024 as chunk, h from bytes)"


def _byte(at: str) -> str:
    """The byte of docs.hx at an offset, as a number; null beyond the end."""
    digit = lambda k: f"(instr('0123456789ABCDEF', substr(hx, 2 * ({at}) + {k}, 1)) - 1)"
    return f"(case when ({at}) >= 0 and 2 * ({at}) + 2 <= strlen(hx) then ({digit(1)} * 16 + {digit(2)})::bigint end)"


def _number(*ats: str) -> str:
    """Bytes from the greatest place on, as one number."""
    return "(" + " + ".join(f"{_byte(a)} * {256 ** (len(ats) - 1 - i)}" for i, a in enumerate(ats)) + ")"


MATCHES = f"""{DOCS}, {BYTES},
    runs as (select artifact_id, pos, h, lead(h) over o as h2, lead(h, 2) over o as h3, lead(h, 3) over o as h4 from bytes window o as (partition by artifact_id order by pos)),
    found as (
        select artifact_id, 0 as pattern_idx, 'the' as name, 'Crypto' as category, pos as "offset", 3 as length, h || h2 || h3 as data from runs where h = '74' and h2 = '68' and h3 = '65'
        union all select artifact_id, 1, 'of', 'Api', pos, 4, h || h2 || h3 || h4 from runs where h || h2 || h3 || h4 = '206F6620'
        union all select artifact_id, 2, 'wild', 'Malware', pos, 4, h || h2 || h3 || h4 from runs where h = '74' and h2 = '68' and h4 = '20'
        union all select artifact_id, 3, 'head', 'FileFormat', pos, 2, h || h2 from runs where pos = 0 and h || h2 = '5468'),
    matches as (select * from (select *, row_number() over (partition by artifact_id order by pattern_idx, "offset") as k from found) where k <= 1000)"""
#: Without the limit: counts of a corpus are counts of all matches.
ALL_MATCHES = MATCHES.replace(" where k <= 1000)", ")")

EVENTS = "ev as (select *, (user_id % 50)::varchar as artifact_id from events)"
IMPORTS = f"imports as (select artifact_id, event_id as ordinal, {_list(APIS)}[(event_id % {len(APIS)} + 1)::int] as name, event_type as library from ev)"
SECTIONS = f"""sections as (select artifact_id, event_id as ordinal, {_list(SECTION_NAMES)}[(event_id % {len(SECTION_NAMES)} + 1)::int] as name, event_id * 64 as address,
    event_id % 5 * 64 as size, event_id % 3 = 0 as w, event_id % 4 = 0 as x from ev)"""
SYMBOLS = f"""symbols as (select artifact_id, event_id as ordinal, {_list(SYMBOL_NAMES)}[(event_id % {len(SYMBOL_NAMES)} + 1)::int] as name, user_id as address, event_id % 4 as size,
    case when event_id % 3 = 0 then 'Object' else 'Function' end as symbol_type from ev)"""
FEATS = "features as (select distinct artifact_id, " + ", ".join(f"artifact_id::int // {1 << k} % 2 = 1 as {c}" for k, c in enumerate(("nx_bit", "aslr", "stack_canary", "cfi", "pie"))) + " from ev)"
RULES = "rules as (select * from (values " + ", ".join(f"('{k}', {w}::double, '{c}', '{s}', '{t}', '{a}')" for k, w, c, s, t, names in API_LISTS for a in names) + ") r(list, weight, category, severity, txt, api))"
_any = lambda tokens: "(" + " or ".join(f"contains(lower(name), '{t}')" for t in tokens) + ")"
FOUND = f"""found as (
    select artifact_id, 0 as stage, ordinal, category, severity, txt || ': ' || name as description, library as location, name as data from imports join rules on name = api
    union all select artifact_id, 1, ordinal, 'CodeInjection', 'High', 'Section ''' || name || ''' is both executable and writable (RWX)', '0x' || lower(to_hex(address)), name from sections where w and x
    union all select artifact_id, 1, ordinal, 'Obfuscation', 'Medium', 'Suspicious section name: ' || name, '0x' || lower(to_hex(address)), name from sections where {_any(SECTION_TOKENS)}
    union all select artifact_id, 2, ordinal, 'SuspiciousApi', 'Medium', 'Suspicious symbol: ' || name, '0x' || lower(to_hex(address)), name from symbols where {_any(SYMBOL_TOKENS)}
    """ + " ".join(f"union all select artifact_id, 3, {i}, 'MissingSecurity', '{s}', '{t}', null, null from features where not {c}" for i, (c, s, t, _) in enumerate(FEATURES) if s) + ")"
SECURITY = f"{EVENTS}, {IMPORTS}, {SECTIONS}, {SYMBOLS}, {FEATS}, {RULES}, {FOUND}"

INSTRUCTIONS = f"""named as (
    select (user_id % 50)::varchar as artifact_id, user_id as function_addr, row_number() over (partition by user_id order by ts, event_id) - 1 as idx,
        {_list(MNEMONICS)}[(event_id % {len(MNEMONICS)} + 1)::int] as mnemonic, event_id * 7 % 61 * 4 as target, 'r' || json_extract_string(props, '$.k') || ', ' || event_type as regs from events),
    instructions as (
    select artifact_id, function_addr, idx, idx * 4 as address, mnemonic,
        case when mnemonic in ('jne', 'je', 'jmp', 'call', 'loop') then target::varchar when mnemonic in ('ret', 'nop', 'syscall') then '' else regs end as operands,
        case when mnemonic = 'ret' then 'Return' when mnemonic = 'call' then 'Call' when mnemonic = 'jmp' then 'Jump' when mnemonic in ('jne', 'je') then 'ConditionalJump'
            when mnemonic in ('int', 'syscall') then 'Interrupt' else 'Sequential' end as flow_kind,
        case when mnemonic in ('jne', 'je', 'jmp', 'call') then target end as flow_target from named)"""
BLOCKS = f"""{INSTRUCTIONS},
    targets as (select distinct artifact_id, function_addr, flow_target as address from instructions where flow_target is not null),
    leaders as (
        select i.*, (t.address is not null or idx = 0 or coalesce(lag(flow_kind) over (partition by artifact_id, function_addr order by idx) in ('Jump', 'ConditionalJump', 'Call', 'Return', 'Interrupt'), false))::int as leader
        from instructions i left join targets t using (artifact_id, function_addr, address)),
    blocked as (select *, (sum(leader) over (partition by artifact_id, function_addr order by idx) - 1)::int as block from leaders),
    blocks as (
        select artifact_id, function_addr, block, min(address) as start, max(address) + 4 as "end", count(*) as n, arg_max(flow_kind, idx) as flow_kind,
            max(flow_target) filter (is_last) as flow_target, arg_max(mnemonic, idx) as last_mnemonic, arg_min(mnemonic, idx) as first_mnemonic
        from (select *, idx = max(idx) over (partition by artifact_id, function_addr, block) as is_last from blocked) group by 1, 2, 3),
    edges as (
        select b.artifact_id, b.function_addr, b.block as src, t.block as dst, 0 as ord from blocks b join blocks t on t.artifact_id = b.artifact_id and t.function_addr = b.function_addr and t.start = b.flow_target
        where b.flow_kind in ('Jump', 'ConditionalJump')
        union all
        select artifact_id, function_addr, block, block + 1, 1 from (select *, max(block) over (partition by artifact_id, function_addr) as most from blocks) where block < most and flow_kind not in ('Jump', 'Return', 'Interrupt')),
    outs as (select artifact_id, function_addr, src as block, count(*) as out_edges from edges group by all),
    ins as (select artifact_id, function_addr, dst as block, count(*) as in_edges from edges group by all),
    graph as (select b.*, coalesce(out_edges, 0) as out_edges, coalesce(in_edges, 0) as in_edges from blocks b left join outs using (artifact_id, function_addr, block) left join ins using (artifact_id, function_addr, block))"""
HALSTEAD = """ops as (select artifact_id, function_addr, count(distinct mnemonic) as n1, count(*) as big1 from instructions group by 1, 2),
    args as (select artifact_id, function_addr, count(distinct o) as n2, count(*) as big2 from (select artifact_id, function_addr, trim(unnest(string_split(operands, ','))) as o from instructions) where o <> '' group by 1, 2),
    halstead as (
        select artifact_id, function_addr, n1, coalesce(n2, 0) as n2, n1 + coalesce(n2, 0) as vocabulary, big1 + coalesce(big2, 0) as length,
            case when coalesce(n2, 0) = 0 then 'nan'::double else n1 * log2(n1) + n2 * log2(n2) end as calculated_length, (big1 + coalesce(big2, 0)) * log2(n1 + coalesce(n2, 0)) as volume,
            case when coalesce(n2, 0) > 0 then n1 / 2.0 * (big2::double / n2) else 0.0 end as difficulty
        from ops left join args using (artifact_id, function_addr))"""
METRICS = f"""{BLOCKS}, {HALSTEAD},
    marked as (
        select b.*, mnemonic in {_in(LOOPS)} as loops, g.out_edges > 1 and idx = max(idx) over (partition by artifact_id, function_addr, block) as splits from blocked b join graph g using (artifact_id, function_addr, block)),
    nested as (select *, coalesce(sum(loops::int + splits::int) over (partition by artifact_id, function_addr order by idx rows between unbounded preceding and 1 preceding), 0) as nest from marked),
    cognitive as (
        select artifact_id, function_addr, sum(((flow_kind = 'ConditionalJump')::int + (mnemonic in {_in(CONDITIONS)})::int + loops::int) * (1 + nest) + (mnemonic in {_in(TRAPS)})::int)::bigint as cognitive from nested group by 1, 2),
    counts as (
        select artifact_id, function_addr, count(*) as block_count, sum(out_edges)::bigint as edge_count, max(in_edges)::int as nesting_depth, (greatest(sum(out_edges) - count(*), 0) + 2)::bigint as cyclomatic from graph group by 1, 2),
    metrics as (
        select *, case when volume > 0 then greatest(0.0, least(100.0, 171 - 5.2 * ln(volume) - 0.23 * cyclomatic - 16.2 * ln(block_count))) end as maintainability
        from counts join cognitive using (artifact_id, function_addr) join halstead using (artifact_id, function_addr))"""

CALLS = f"""nodes as (select distinct 'a' as artifact_id, user_id as address, {_list(SYMBOL_NAMES)}[(user_id % {len(SYMBOL_NAMES)} + 1)::int] || '_' || user_id as name from events),
    edges as (select 'a' as artifact_id, e.user_id as caller, f.user_id as callee, case when e.user_id = f.user_id then 'Recursive' else 'Direct' end as call_type from events e join events f on f.event_id = e.event_id + 1 where e.event_type = 'click'),
    entry as (select min(user_id) as address from events)"""
DEPTHS = """walk(address, depth) as (select address, 0 from entry union select callee, depth + 1 from walk join edges on caller = address where depth < 40),
    depths as (select address, min(depth) as depth from walk group by 1)"""
CLOSURE = """hops as (select distinct caller, callee from edges),
    reach(a, b) as (select caller, callee from hops union select a, callee from reach join hops on caller = b),
    cyclic as (select distinct a as address from reach where a = b),
    recursive_nodes as (select address from cyclic union select a from reach join cyclic on b = address)"""
_library = "(" + " or ".join([f"starts_with(name, '{p}')" for p in LIBRARY_PREFIXES] + [f"contains(name, '{p}')" for p in LIBRARY_NAMES]) + ")"
_order = "[" + ", ".join(f"'{s}'" for s in SEVERITIES) + "]"

# What parsing the samples must give, said from the numbers they are made of (see plans.samples).
KS = "ks as (select p_partkey as k, p_partkey // 7 as n, p_partkey % 7 as f, p_partkey::varchar as artifact_id from part)"


def _rows(*structs: str) -> str:
    return f"unnest([{', '.join('{' + x + '}' for x in structs)}], recursive := true)"


def _section(ordinal: int, name: str, kind: str, address: str = "0", size: str = "0", w: bool = False, x: bool = False, offset: str = "0", inline: str = "null") -> str:
    name = name if name.startswith("[") else f"'{name}'"
    return f"'ordinal': {ordinal}, 'name': {name}, 'section_type': '{kind}', 'address': ({address})::bigint, 'size': ({size})::bigint, 'w': {w}, 'x': {x}, 'offset': ({offset})::bigint, 'inline': ({inline})::int"


_ELF_ROWS = [
    (".text", "Code", "4198400 + 16 * k", "14 + k % 32", False, True), (".data", "Data", "5242880", "8", True, False), (".rodata", "ReadOnlyData", "5308416", "k % 3", False, False),
    (".debug_info", "Debug", "0", "1", False, False), (".bss", "Bss", "5373952", "k % 2000", True, False), (".note", "Note", "0", "1", False, False), (".rela", "Relocation", "0", "0", False, False),
    (".dynamic", "Dynamic", "0", "0", True, False), (".odd", "Other:SHT_99", "0", "0", False, False), (".big", "ReadOnlyData", "5439488", "2000", False, False),
    (".symtab", "Symbol", "0", "6 * (24 - 8 * f)", False, False), (".strtab", "String", "0", "32", False, False), (".dynsym", "Other:SHT_11", "0", "4 * (24 - 8 * f)", False, False),
    (".dynstr", "String", "0", "18", False, False), ("['.comment', '.go.buildinfo', '.rustc', '.plain'][n % 4 + 1]", "ReadOnlyData", "0", "[17, 1, 1, 1][n % 4 + 1]", False, False),
    (".shstrtab", "String", "0", "[120, 125, 118, 118][n % 4 + 1]", False, False),
]
_ELF = ", ".join([
    "elf as (select * from ks where f in (0, 1))",
    f"elf_rows as (select artifact_id, k, f, {_rows(_section(0, '', 'Other:SHT_0', inline='0'), *[_section(i + 1, *row) for i, row in enumerate(_ELF_ROWS)])} from elf)",
    """elf_sections as (
        select * replace (
            case when ordinal > 0 then 64 - 12 * f + (56 - 24 * f) * ((k % 5 <> 0)::int + (k % 3 = 0)::int) + coalesce(sum(case when section_type = 'Bss' then 0 else size end) over (partition by artifact_id order by ordinal rows between unbounded preceding and 1 preceding), 0) else 0 end::bigint as "offset",
            case when section_type <> 'Bss' and size <= 1024 then size end::int as inline) from elf_rows)""",
])
_SECTION_COLUMNS = 'artifact_id, ordinal, name, address, size, "offset", true as perm_read, w as perm_write, x as perm_execute, section_type, inline'
_PE_ROWS = _rows(
    _section(0, ".text", "Code", "4096", "14", False, True, "1024", "512"), _section(1, ".data", "Data", "8192", "1024", True, False, "1536", "1024"), _section(2, ".rdata", "ReadOnlyData", "12288", "k % 64", False, False, "2560"),
    _section(3, ".bss", "Bss", "16384", "99", True), _section(4, ".odd", "Other:PE_SECTION", "20480", "1"),
)
_MACHO_ROWS = _rows(*[
    _section(i, name, kind, str(4096 + 64 * i), "14" if i == 0 else f"{8 * i} + k % 8", False, False, "0" if i == 3 else str(1024 + 64 * i), "null" if i == 3 else "14" if i == 0 else f"{8 * i} + k % 8")
    for i, (name, kind) in enumerate((("__text", "Code"), ("__data", "Data"), ("__const", "ReadOnlyData"), ("__bss", "Bss"), ("__debug_line", "Debug"), ("__other", "Other:MACHO_SECTION")))
])
_WASM_ROWS = _rows(
    _section(0, "note", "Other:note", "0", "k % 50", False, False, "16"), _section(1, "import", "Other:Import", "0", "24", False, False, "29 + k % 50"), _section(2, "export", "Other:Export", "0", "12", False, False, "61 + k % 50"),
    _section(3, "code", "Code", "0", "9", False, True, "76 + 4 * (k % 3 > 0)::int + k % 50"), _section(4, "data", "Data", "0", "2 + k % 7", True, False, "88 + 4 * (k % 3 > 0)::int + k % 50"),
)
_SYMBOL = "'ordinal': {}, 'name': '{}', 'demangled_name': {}, 'address': ({})::bigint, 'size': ({})::bigint, 'symbol_type': '{}', 'binding': '{}', 'visibility': '{}', 'section_index': {}::bigint"
_ELF_SYMBOLS = _rows(
    _SYMBOL.format(0, "main", "null::varchar", "4198400 + 16 * k", "14", "Function", "Global", "Default", "1"), _SYMBOL.format(1, "_Z3foov", "'demangled__Z3foov'", "4198404 + 16 * k", "k % 9", "Function", "Weak", "Hidden", "1"),
    _SYMBOL.format(2, "local", "null", "8", "4", "Object", "Local", "Internal", "2"), _SYMBOL.format(3, "file.c", "null", "0", "0", "File", "Local", "Protected", "null"), _SYMBOL.format(4, "odd", "null", "0", "0", "Other:STT_15", "Other:STB_3", "Default", "null"),
)
_JAR_SYMBOLS = _rows(*[_SYMBOL.format(i, name, "null::varchar", "0", size, "Object", "Global", "Default", "null") for i, (name, size) in enumerate((("a/B.class", "k % 100"), ("C.class", "7")))])
_BINARY_SYMBOLS = f"symbols as (select artifact_id, {_ELF_SYMBOLS} from ks where f in (0, 1) union all select artifact_id, {_JAR_SYMBOLS} from ks where f = 5 and n % 3 = 1)"
_FALSE = ", ".join("false" for _ in range(8))
#: (offset, bytes, mnemonic, operands, flow, offset of the target, category) of the samples' code, for 64 and 32 bits.
_CODE = {
    64: [(0, "55", "push", "rbp", "Sequential", None, "Memory"), (1, "4889E5", "mov", "rbp, rsp", "Sequential", None, "Memory")],
    32: [(0, "55", "push", "ebp", "Sequential", None, "Memory"), (1, "48", "dec", "eax", "Sequential", None, "Arithmetic"), (2, "89E5", "mov", "ebp, esp", "Sequential", None, "Memory")],
}
_CODE_END = [(4, "7501", "jne", None, "ConditionalJump", 7, "Control"), (6, "CC", "int3", "", "Interrupt", None, "System"), (7, "E801000000", "call", None, "Call", 13, "Control"), (12, "90", "nop", "", "Sequential", None, "Unknown"), (13, "C3", "ret", "", "Return", None, "Control")]
_quoted = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
_CODE_ROWS = ", ".join(f"({bits}, {i}, {', '.join(map(_quoted, row))})" for bits, rows in _CODE.items() for i, row in enumerate(rows + _CODE_END))
BINARY_CODE = f"""with {KS},
    machine as (
        select artifact_id, k, case when f < 2 then ['X86', 'X86_64', '', '', '', '', '', '', ''][n % 9 + 1] when f < 4 then ['X86', 'X86_64', '', '', ''][n % 5 + 1] when f = 4 and k % 2 = 1 then ['X86', 'X86_64', '', '', '', '', ''][n % 7 + 1] end as a,
            case when f < 2 then 4198400 + 16 * k else 4096 end::bigint as function_addr, case when f < 2 then k % 32 when f < 4 then 498 else 0 end as zeros from ks where f < 5),
    x86 as (select *, case a when 'X86' then 32 else 64 end as bits from machine where a in ('X86', 'X86_64')),
    code(bits, idx, place, bytes, mnemonic, operands, flow_kind, goal, category) as (values {_CODE_ROWS}),
    body as (
        select artifact_id, function_addr, idx, function_addr + place as address, bytes, mnemonic, coalesce(operands, '0x' || lower(to_hex(function_addr + goal))) as operands, flow_kind, function_addr + goal as flow_target, strlen(bytes) // 2 as size, category
        from x86 join code using (bits)
        union all
        select artifact_id, function_addr, j + case bits when 64 then 7 else 8 end, function_addr + 14 + 2 * j, '0000', 'add', case bits when 64 then 'byte [rax], al' else 'byte [eax], al' end, 'Sequential', null, 2, 'Arithmetic'
        from (select *, unnest(range(zeros // 2)) as j from x86)
        union all
        select artifact_id, 4096 + 64 * i, j, 4096 + 64 * i + 2 * j, '0000', 'add', case bits when 64 then 'byte [rax], al' else 'byte [eax], al' end, 'Sequential', null, 2, 'Arithmetic'
        from (select *, unnest(range((8 * i + k % 8) // 2)) as j from (select *, unnest([1, 2, 4, 5]) as i from x86 where k % 7 = 4)))
    select artifact_id, function_addr::bigint as function_addr, idx::int as idx, address::bigint as address, bytes, mnemonic, operands, flow_kind, flow_target::bigint as flow_target, size::int as size, category from body"""

ORACLES: dict[str, str] = {
    "binary_formats": f"""with {KS} select case when f < 2 then 'Elf' when f < 4 then 'Pe' when f = 4 then 'MachO' when f = 5 then 'Java' else ['Wasm', 'Raw', 'Raw', 'Elf', null][n % 5 + 1] end as format,
        count(*) as n, count(*) filter (f = 6 and n % 5 = 4) as errors from ks group by 1""",
    "binary_predicates": f"""with {KS} select artifact_id, f < 2 or (f = 6 and n % 5 = 3) as is_elf, f in (2, 3) as is_pe, f = 4 or (f = 5 and n % 3 <> 1) as is_macho, f = 5 or (f = 6 and n % 5 = 1) as is_java,
        f = 6 and n % 5 = 0 as is_wasm, true as is_raw from ks""",
    "binary_metadata": f"""with {KS},
        own(artifact_id, failed, format, architecture, entry_point, base_address, "timestamp", compiler_info, endian, nx_bit, aslr, stack_canary, cfi, fortify, pie, relro, signed) as (
            select artifact_id, false, 'Elf', ['X86', 'X86_64', 'Arm', 'Arm64', 'Mips', 'PowerPC', 'PowerPC64', 'RiscV', 'Unknown'][n % 9 + 1], case when k % 3 > 0 then 4198400 + 16 * k end, null, null,
                ['GCC: (sample) 13', 'Go compiler', 'Rust compiler', null][n % 4 + 1], ['Little', 'Big'][f + 1], k % 5 > 0 and k % 2 = 0, n % 2 = 0, false, false, false, n % 2 = 0, k % 3 = 0, false from ks where f < 2
            union all select artifact_id, false, 'Pe', ['X86', 'X86_64', 'Arm', 'Arm64', 'Unknown'][n % 5 + 1], [5368709120, 4194304][f - 1] + 4096 + k % 256, [5368709120, 4194304][f - 1], 1600000000 + k,
                case when k % 4 > 0 then 'MSVC (detected from symbols)' end, 'Little', k % 2 = 1, k % 3 = 0, false, k % 5 = 0, false, k % 3 = 0, false, k % 4 = 1 from ks where f in (2, 3)
            union all select artifact_id, false, 'MachO', ['X86', 'X86_64', 'Arm', 'Arm64', 'PowerPC', 'PowerPC64', 'Unknown'][n % 7 + 1], null, null, null, 'Unknown Apple toolchain', case when n % 4 < 2 then 'Little' else 'Big' end,
                true, k % 2 = 1, false, false, false, k % 2 = 1, false, false from ks where f = 4
            union all select artifact_id, false, 'Java', 'Jvm', null, null, null, case n % 3 when 0 then 'Java class version ' || (45 + k % 20) || '.' || (k % 4) when 1 then 'Java archive' else 'Java class version 0.0' end, 'Big', {_FALSE} from ks where f = 5
            union all select artifact_id, false, 'Wasm', 'Wasm', case when k % 3 > 0 then k % 3 end, null, null, null, 'Little', {_FALSE} from ks where f = 6 and n % 5 = 0
            union all select artifact_id, false, 'Raw', 'Unknown', null, 0, null, null, 'Little', {_FALSE} from ks where f = 6 and n % 5 in (1, 2)
            union all select artifact_id, true, ['Elf', null][n % 5 - 2], null, null, null, null, null, null, {_FALSE.replace('false', 'null')} from ks where f = 6 and n % 5 > 2)
        select * replace (entry_point::bigint as entry_point, base_address::bigint as base_address, "timestamp"::bigint as "timestamp") from own""",
    "binary_sections": f"""with {KS}, {_ELF},
        others as (
            select artifact_id, {_PE_ROWS} from ks where f in (2, 3)
            union all select * exclude (k) replace (k % 2 = 0 as w, k % 2 = 1 as x) from (select artifact_id, k, {_MACHO_ROWS} from ks where f = 4)
            union all select artifact_id, {_rows(_section(0, "['class', 'jar', 'class'][n % 3 + 1]", 'Data', '0', '[8 + k % 9, 312 + k % 100, 4][n % 3 + 1]'))} from ks where f = 5
            union all select artifact_id, {_WASM_ROWS} from ks where f = 6 and n % 5 = 0
            union all select artifact_id, {_rows(_section(0, '.data', 'Data', '0', 'case n % 5 when 1 then 118 + k % 100 else 1 + k % 2000 end', False, False, '0', 'case when n % 5 = 1 then 118 + k % 100 when k % 2000 < 1024 then 1 + k % 2000 end'))}
                from ks where f = 6 and n % 5 in (1, 2))
        select {_SECTION_COLUMNS} from elf_sections union all select {_SECTION_COLUMNS} from others""",
    "binary_symbols": f"with {KS}, {_BINARY_SYMBOLS} select * from symbols",
    "binary_demangled": f"with {KS}, {_BINARY_SYMBOLS} select name, case name when '_Z3foov' then 'foo()' end as demangled_name, count(*) as n from symbols group by 1, 2",
    "binary_imports": f"""with {KS}, own(artifact_id, ordinal, name, library, address, import_ordinal) as (
            select artifact_id, 0, 'printf', null, null, null from ks where f < 2
            union all select artifact_id, 0, 'VirtualAllocEx', 'KERNEL32.dll', 9472, 7 from ks where f in (2, 3)
            union all select artifact_id, 1, 'ORDINAL ' || (k % 1000), 'KERNEL32.dll', 9472 + [8, 4][f - 1], k % 1000 from ks where f in (2, 3)
            union all select artifact_id, 2, 'VirtualAllocEx', 'user32.dll', 8576, 7 from ks where f in (2, 3)
            union all select artifact_id, 0, '_printf', '/usr/lib/libSystem.dylib', 4096 + k % 100, null from ks where f = 4
            union all select artifact_id, 1, '_puts', '/usr/lib/libSystem.dylib', 4096 + k % 100 + [8, 4][n % 2 + 1], null from ks where f = 4
            union all select artifact_id, 0, 'f' || (k % 10), 'env', null, null from ks where f = 6 and n % 5 = 0
            union all select artifact_id, 1, 'memory', 'env', null, null from ks where f = 6 and n % 5 = 0)
        select * replace (address::bigint as address, import_ordinal::int as import_ordinal) from own""",
    "binary_exports": f"""with {KS}, own(artifact_id, ordinal, name, address, forwarded_name) as (
            select artifact_id, 0, 'api', 4198408 + 16 * k, null from ks where f < 2
            union all select artifact_id, 0, 'run', 4096 + k % 256, null from ks where f in (2, 3)
            union all select artifact_id, 1, 'fwd', 8816, 'lib.func' from ks where f in (2, 3)
            union all select artifact_id, 0, '_main', 128 + k % 128, null from ks where f = 4
            union all select artifact_id, 0, 'add', 0, null from ks where f = 6 and n % 5 = 0
            union all select artifact_id, 1, 'g' || (k % 5), 0, null from ks where f = 6 and n % 5 = 0)
        select * replace (address::bigint as address) from own""",
    "binary_code": BINARY_CODE,
    "builtin_binary_patterns": f"""with {KS}, m as (
            select artifact_id, 'PE_MZ' as name, 'FileFormat' as category from ks where f in (2, 3)
            union all select artifact_id, 'ELF', 'FileFormat' from ks where f < 2 or (f = 6 and n % 5 = 3)
            union all select artifact_id, 'Suspicious_API', 'Malware' from ks where false
            union all select artifact_id, ['Mach_O_32', 'Mach_O_64'][(n % 2 = 0)::int + 1], 'FileFormat' from ks where f = 4 and n % 4 > 1)
        select name, category, count(*) as n, count(distinct artifact_id) as artifacts from m group by 1, 2""",
    "matches_by_category": f"""with {KS} select artifact_id, 'FileFormat' as category, case when f in (2, 3) then 'PE_MZ' when f = 4 then ['Mach_O_32', 'Mach_O_64'][(n % 2 = 0)::int + 1] else 'ELF' end as names
        from ks where f in (2, 3) or f < 2 or (f = 6 and n % 5 = 3) or (f = 4 and n % 4 > 1)""",
    "described_regions": f"""with {KS} select artifact_id, 0::bigint as start, case k % 4 when 0 then 1024 else 964 end::bigint as "end",
        ['Likely encrypted or compressed data', 'Possible cryptographic constants', 'Possible compressed data', 'High entropy region - possible obfuscation'][k % 4 + 1] as description from ks""",
    "inflated_samples": f"with {KS} select artifact_id, case when k % 4 < 2 then k % 300 end::int as length, k % 4 > 1 as failed from ks",
    "folded_matches": """with t as (select doc_id::varchar as artifact_id, lower(text) as low from documents),
            w(name, word) as (values ('é', 'é'), ('ung', 'ung '))
        select artifact_id, name, ((length(low) - length(replace(low, word, ''))) // length(word))::bigint as n from t, w where contains(low, word)""",
    "kept_call_nodes": f"with {CALLS} select artifact_id, address, name from nodes qualify row_number() over (partition by artifact_id order by address) <= 20",
    "program_unreachable": """with recursive calls as (select distinct (e.event_id // 4000)::varchar as artifact_id, e.user_id as caller, f.user_id as callee from events e join events f on f.event_id = e.event_id + 1 where e.event_type = 'click'),
            nodes as (select artifact_id, caller as address from calls union select artifact_id, callee from calls),
            reached(artifact_id, address) as (select artifact_id, min(address) from nodes group by 1 union select r.artifact_id, callee from reached r join calls c on c.artifact_id = r.artifact_id and c.caller = r.address)
        select artifact_id, address from nodes except select artifact_id, address from reached""",
    "entropy_packing_levels": f"with {DOCS}, {BYTES}, {WHOLE} select {LEVEL} as obfuscation_level, count(*) as n, round(sum(entropy), 4) as entropy, count(*) filter (entropy > 7.5) as packed from whole group by 1",
    "artifact_entropy": f"with {DOCS}, {BYTES}, {WHOLE} select artifact_id, round(entropy, 6) as entropy from whole",
    "page_entropy": f"with {PAGE_BYTES}, {WHOLE} select artifact_id, round(entropy, 6) as entropy from whole",
    "byte_frequencies": f"with {DOCS}, {BYTES} select ((instr('0123456789ABCDEF', substr(h, 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2, 1)) - 1)::int as byte, count(*) as n from bytes group by 1",
    "byte_chi_square": f"""with {DOCS}, {BYTES}, c as (select artifact_id, h, count(*) as n from bytes group by 1, 2), t as (select artifact_id, sum(n) / 256.0 as want, count(*) as used from c group by 1)
        select artifact_id, round(sum((n - want) * (n - want) / want) + (256 - any_value(used)) * any_value(want), 4) as chi_square from c join t using (artifact_id) group by 1""",
    "chunk_entropy": f"""with {DOCS}, {BYTES}, {CHUNKS}, e as ({_entropy('artifact_id, chunk', 'chunked')})
        select artifact_id, chunk::int as chunk, chunk * 1024 as start, least(chunk * 1024 + 1024, strlen(hx) // 2) as "end", round(entropy, 6) as entropy from e join docs using (artifact_id)""",
    "dense_regions": f"""with {DOCS}, {BYTES}, {CHUNKS}, e as ({_entropy('artifact_id, chunk', 'chunked')})
        select artifact_id, chunk * 1024 as start, least(chunk * 1024 + 1024, strlen(hx) // 2) as "end", round(entropy, 6) as entropy, 'High entropy region - possible obfuscation' as description
        from e join docs using (artifact_id) where entropy > 4.5""",
    "packing_indicators": f"""with {DOCS}, {BYTES}, {WHOLE} select artifact_id, round(entropy, 6) as entropy, entropy > 7.5 as is_packed, {PACKER} as packer_name,
        case when entropy > 7.5 then entropy / 8 end as compression_ratio, {LEVEL} as obfuscation_level from whole join docs using (artifact_id)""",
    "detect_formats": """with hx as (select hex(encode(text)) as h from documents union all select hex(encode(html)) from pages)
        select case when h = '' then null when starts_with(h, '7F454C46') then 'Elf' when starts_with(h, '4D5A') then 'Pe' when substr(h, 1, 8) in ('FEEDFACE', 'FEEDFACF', 'CEFAEDFE', 'CFFAEDFE') then 'MachO'
            when starts_with(h, 'CAFEBABE') then 'Java' when starts_with(h, '0061736D') then 'Wasm' else 'Raw' end as format, count(*) as n from hx group by 1""",
    "parser_predicates": f"""with {DOCS} select artifact_id, starts_with(hx, '7F454C46') as is_elf, false as is_pe, substr(hx, 1, 8) in ('FEEDFACE', 'FEEDFACF', 'CEFAEDFE', 'CFFAEDFE', 'CAFEBABE', 'BEBAFECA') as is_macho,
        starts_with(hx, 'CAFEBABE') or starts_with(hx, '504B0304') as is_java, starts_with(hx, '0061736D') as is_wasm, true as is_raw from docs""",
    "byte_readers": f"""with {DOCS} select artifact_id, {_byte('0')} as u8, {_number('2', '1')} as u16, {_number('2', '3', '4', '5')} as u32,
        {_number('strlen(hx) // 2 - 2', 'strlen(hx) // 2 - 1')} as last16, {_number('63', '62', '61', '60')} as u32_60 from docs""",
    "byte_views": f"""with {DOCS} select artifact_id, case when strlen(hx) >= 22 then substr(hx, 7, 16) end as view,
        text, starts_with(text, 'Th') as starts, contains(text, ' of ') as holds from docs""",
    "parsed_metadata": f"""with {DOCS} select artifact_id, null::varchar as error, strlen(text)::bigint as size, 'Raw' as format, 'Unknown' as architecture, null::bigint as entry_point, 0::bigint as base_address,
        null::varchar as compiler_info, 'Little' as endian, false as nx_bit, false as pie from docs""",
    "parsed_sections": f"""with {DOCS} select artifact_id, 0 as ordinal, '.data' as name, 0::bigint as address, strlen(text)::bigint as size, 0::bigint as "offset", true as perm_read, false as perm_write,
        false as perm_execute, 'Data' as section_type, case when strlen(text) <= 1024 then strlen(text)::int end as "inline" from docs""",
    "section_entropy": f"""with {DOCS}, {BYTES}, n as (select artifact_id, strlen(text) as n from docs),
        parts as (select artifact_id, 'body' as name, h from bytes join n using (artifact_id) where n > 100 and pos >= 100
            union all select artifact_id, 'head', h from bytes join n using (artifact_id) where n >= 250 and pos >= 50 and pos < 250
            union all select artifact_id, 'head', h from bytes join n using (artifact_id) where n >= 200 and n < 250 and pos < 200),
        e as ({_entropy('artifact_id, name', 'parts')}) select artifact_id, name, round(entropy, 6) as entropy from e""",
    "pattern_matches": f'with {MATCHES} select artifact_id, pattern_idx, name, category, "offset", length, data from matches',
    "pattern_categories": f'with {ALL_MATCHES} select category, name, count(*) as n, count(distinct artifact_id) as artifacts, sum("offset")::bigint as offsets from matches group by 1, 2',
    "builtin_patterns": """with t as (select html from pages), p(name, category, s, magic) as (values ('PE_MZ', 'FileFormat', 'MZ', true), ('GCC', 'Compiler', 'GCC:', false), ('MSVC', 'Compiler', 'Microsoft C/C++', false),
            ('UPX', 'Packer', 'UPX!', false), ('Suspicious_API', 'Malware', 'VirtualAllocEx', false), ('CreateProcess', 'Api', 'CreateProcessA', false))
        select name, category, sum(case when magic then starts_with(html, s)::bigint else (length(html) - length(replace(html, s, ''))) // length(s) end)::bigint as n from t, p
        where (magic and starts_with(html, s)) or (not magic and contains(html, s)) group by 1, 2""",
    "top_pattern_categories": f"""with {ALL_MATCHES}, totals as (select category, count(*) as n from matches group by 1),
        ranked as (select *, row_number() over (partition by category order by artifact_id, pattern_idx, "offset")::int as rank from matches)
        select category, n, rank, artifact_id, name, "offset" from ranked join totals using (category) where rank <= 5""",
    "overlapping_counts": f"""with {DOCS}, {BYTES}, runs as (select artifact_id, h, lead(h) over o as h2, lead(h, 2) over o as h3, lead(h, 3) over o as h4 from bytes window o as (partition by artifact_id order by pos)),
        c as (select artifact_id, count(*) filter (h || h2 || h3 = '746865') as the, count(*) filter (h || h2 = '7468' and h3 is not null and h4 = '20') as wild from runs group by 1)
        select artifact_id, coalesce(the, 0) as the, coalesce(wild, 0) as wild from docs left join c using (artifact_id)""",
    "printable_strings": r"""select doc_id::varchar as artifact_id, (generate_subscripts(regexp_extract_all(text, '[\x20-\x7e]{12,}'), 1) - 1)::int as ordinal, unnest(regexp_extract_all(text, '[\x20-\x7e]{12,}')) as text from documents""",
    "string_indicators": r"""with t as (select doc_id::varchar as artifact_id, text as x from documents union all select 'p' || page_id, html from pages),
        f as (select artifact_id, 'url' as kind, unnest(regexp_extract_all(x, '(?:https?|ftp)://[\x21\x23-\x26\x28-\x3b\x3d\x3f-\x7e]+')) as value from t
            union all select artifact_id, 'email', unnest(regexp_extract_all(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) from t)
        select artifact_id, kind, value, count(*) as n from f group by 1, 2, 3""",
    "security_findings": f"with {SECURITY} select artifact_id, stage, ordinal::bigint as ordinal, category, severity, description, location, data from found",
    "security_severities": f"with {SECURITY} select severity, count(*) as n, (list_position({_order}, severity) - 1)::bigint as rank from found group by 1",
    "security_indicators": f"with {EVENTS}, {IMPORTS}, {RULES} select artifact_id, list, list(name order by ordinal, name) as names from imports join rules on name = api group by 1, 2",
    "risk_scores": f"""with ev as (select *, (user_id % 50)::varchar || '/' || event_id // 97 as artifact_id from events), {IMPORTS}, {SECTIONS}, {SYMBOLS},
        ids as (select distinct artifact_id, split_part(artifact_id, '/', 1)::int as k from imports),
        features as (select artifact_id, {", ".join(f"k // {1 << i} % 2 = 1 as {c}" for i, c in enumerate(("nx_bit", "aslr", "stack_canary", "cfi", "pie")))} from ids), {RULES}, {FOUND},
        points as (select artifact_id, weight as p from imports join rules on name = api union all select artifact_id, {_map(SEVERITY_SCORE, 'severity')}::double from found
            union all select artifact_id, {" + ".join(f"case when {c} then 0.0 else {n} end" for c, _, _, n in FEATURES)} from features),
        scores as (select artifact_id, least(100.0, sum(p) / 2)::double as risk from points group by 1)
        select artifact_id, risk, case when risk <= 25 then 'Low' when risk <= 50 then 'Medium' when risk <= 75 then 'High' else 'Critical' end as level from scores""",
    "instruction_classes": f"with {INSTRUCTIONS} select mnemonic, {_map(CATEGORY, 'mnemonic')} as category, flow_kind, count(*) as n, sum(flow_target)::bigint as targets from instructions group by 1, 2, 3",
    "category_shares": f"with {INSTRUCTIONS}, c as (select {_map(CATEGORY, 'mnemonic')} as category, count(*) as n from instructions group by 1) select category, n, round(n * 100.0::double / sum(n) over (), 6) as percent from c",
    "top_mnemonics": f"with {INSTRUCTIONS} select mnemonic, count(*) as n from instructions group by 1 order by 2 desc, 1 limit 10",
    "instruction_totals": f"with {INSTRUCTIONS} select count(*) as n, 4.0::double as avg_size, count(*) filter (flow_kind in ('Jump', 'ConditionalJump')) as jumps, count(*) filter (flow_kind = 'Call') as calls from instructions",
    "basic_blocks": f"with {BLOCKS} select * from blocks",
    "cfg_edges": f"with {BLOCKS} select artifact_id, function_addr, src, dst, ord from edges",
    "block_types": f"""with {BLOCKS} select artifact_id, function_addr, block, case when block = 0 then 'Entry' when out_edges = 0 then 'Exit' when flow_kind = 'Return' then 'Return' when flow_kind = 'Call' then 'Call'
        when flow_kind = 'ConditionalJump' then 'Conditional' else 'Normal' end as block_type, out_edges::int as out_edges, in_edges::int as in_edges from graph""",
    "function_complexity": f"""with {METRICS} select artifact_id, function_addr, block_count, edge_count, cyclomatic, nesting_depth, cognitive, case when cyclomatic between 1 and 10 then 'Low' when cyclomatic between 11 and 20 then 'Moderate'
        when cyclomatic between 21 and 50 then 'High' else 'Very High' end as level, round(maintainability, 6) as maintainability from metrics""",
    "halstead_metrics": f"""with {INSTRUCTIONS}, {HALSTEAD} select artifact_id, function_addr, n1, n2, vocabulary, length, round(calculated_length, 6) as calculated_length, round(volume, 6) as volume,
        round(difficulty, 6) as difficulty, round(difficulty * volume, 3) as effort, round(volume / 3000, 6) as bugs from halstead""",
    "cognitive_summary": f"""with {METRICS} select artifact_id, sum(cognitive)::bigint as total, round(avg(cognitive), 6) as average, max(cognitive) as most, case when max(cognitive) > 0 then
        (list(function_addr order by cognitive desc, function_addr))[1] end as most_complex, count(*) as functions from metrics group by 1""",
    "top_functions": f"with {METRICS} select function_addr, cyclomatic, block_count from metrics order by cyclomatic desc, function_addr limit 5",
    "cfg_dot": f"""with {BLOCKS}, lines as (select artifact_id, function_addr, 0 as part, block as a, 0 as b, '  bb' || block || ' [label="0x' || lower(to_hex(start)) || '"];' as line from blocks
            union all select artifact_id, function_addr, 1, src, ord, '  bb' || src || ' -> bb' || dst || ';' from edges)
        select artifact_id, function_addr, 'digraph CFG {{' || chr(10) || string_agg(line, chr(10) order by part, a, b) || chr(10) || '}}' || chr(10) as dot from lines group by 1, 2""",
    "located_points": f"""with {EVENTS}, {SECTIONS}, p as (select artifact_id, event_id * 64 + 32 as point from ev)
        select p.artifact_id, point, ordinal, name as section from p join sections s on s.artifact_id = p.artifact_id and point >= address and point < address + size
        qualify rank() over (partition by p.artifact_id, point order by ordinal) = 1""",
    "first_text_sections": f"with {EVENTS}, {SECTIONS} select artifact_id, min(ordinal) as ordinal, arg_min(address, ordinal) as address, arg_min(size, ordinal) as size from sections where name = '.text' group by 1",
    "call_graph_functions": f"""with {EVENTS}, {SYMBOLS}, f as (select artifact_id, address as start, min(ordinal) as ordinal, arg_min(name, ordinal) as name, arg_min(size, ordinal) as size
            from symbols where symbol_type = 'Function' and size > 0 group by 1, 2)
        select artifact_id, start, ordinal, name, size::bigint as size from f union all select distinct artifact_id, artifact_id::bigint + 100000, -1, '_start', 1000 from ev""",
    "imports_by_library": f"with {EVENTS}, {IMPORTS} select artifact_id, library, count(*) as n, string_agg(name, ',' order by name) as names from imports group by 1, 2",
    "nation_diff": """with a as (select s_nationkey as key, count(*) as n from supplier group by 1), b as (select c_nationkey as key, count(*) as n from customer where c_acctbal > 0 group by 1)
        select key, case when a.n is null then 'added' when b.n is null then 'removed' when a.n = b.n then 'same' else 'changed' end as status, a.n as old, b.n as "new" from a full join b using (key)""",
    "library_functions": f"""with {EVENTS}, {SYMBOLS} select name, {_library} as is_library, case name when '_ZN3foo3barEv' then 'foo::bar()' end as demangled, count(*) as n from symbols group by 1, 2, 3""",
    "call_degrees": f"""with {CALLS} select artifact_id, address, name, (select count(*) from edges where callee = address) as in_degree, (select count(*) from edges where caller = address) as out_degree from nodes""",
    "call_node_types": f"""with {CALLS} select address, name, case when address = (select address from entry) or name in {_in(ENTRY_NAMES)} then 'EntryPoint' when address % 3 = 0 then 'External'
        when {_library} then 'Library' else 'Internal' end as node_type from nodes""",
    "call_depths": f"with recursive {CALLS}, {DEPTHS} select address, depth from depths",
    "recursive_functions": f"with recursive {CALLS}, {CLOSURE} select 'a' as artifact_id, address from recursive_nodes",
    "unreachable_functions": f"with recursive {CALLS}, {DEPTHS} select address, name from nodes where address not in (select address from depths)",
    "call_statistics": f"""with recursive {CALLS}, {DEPTHS}, {CLOSURE}, n as (select address, depth, address in (select address from recursive_nodes) as rec, address in (select caller from edges) as calls_any from nodes left join depths using (address))
        select 'a' as artifact_id, count(*) as functions, count(*) filter (rec) as recursive_functions, count(*) filter (not calls_any) as leaf_functions, count(*) filter (depth is null) as unreachable_functions,
            coalesce(max(depth), 0)::int as max_depth, round(coalesce(avg(depth), 0), 6) as avg_depth, count(*) filter (rec) as cyclic_dependencies, (select count(*) from edges) as calls,
            (select count(*) from edges where call_type = 'Direct') as direct_calls, 0::bigint as indirect_calls, 1::bigint as entry_points from n""",
    "instruction_calls": f"""with {INSTRUCTIONS}, known as (select distinct artifact_id, idx * 4 as address from instructions),
        direct as (select case when flow_target = function_addr then 'Recursive' else 'Direct' end as call_type, flow_target as callee from instructions i where flow_kind = 'Call' and exists (select 1 from known k where k.artifact_id = i.artifact_id and k.address = flow_target)),
        last as (select * from instructions qualify idx = max(idx) over (partition by artifact_id, function_addr)),
        tails as (select 'TailCall', flow_target from last i where flow_kind = 'Jump' and flow_target <> function_addr and exists (select 1 from known k where k.artifact_id = i.artifact_id and k.address = flow_target))
        select call_type, callee, count(*) as n from (select * from direct union all select * from tails) group by 1, 2""",
    "metadata_json": """select doc_id::varchar as artifact_id, '{"artifact_id":"' || doc_id || '","length":' || strlen(text) || '}' as json, strlen(text)::bigint as read_length from documents""",
    "hourly_events": "select date_trunc('hour', ts)::timestamp as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "user_sessions": """with g as (select user_id, ts, case when ts >= lag(ts) over o + interval 30 minutes or lag(ts) over o is null then 1 else 0 end as fresh from events window o as (partition by user_id order by ts)),
        s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as started, count(*) as n from s group by user_id, k""",
    "artifact_triage": f"""with {PAGE_BYTES}, {WHOLE}, p as (select page_id::varchar as artifact_id, html, hex(encode(html)) as hx from pages)
        select artifact_id, 'Raw' as format, strlen(html)::bigint as length, round(entropy, 6) as entropy, {LEVEL} as level, {PACKER} as packer_name from p join whole using (artifact_id)""",
    "hexdumps": f"""with {DOCS}, {BYTES}, cells as (select artifact_id, pos, lower(h) as h, case when h between '20' and '7E' then chr(((instr('0123456789ABCDEF', substr(h, 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2, 1)) - 1)::int) else '.' end as c from bytes),
        lines as (select artifact_id, pos // 16 as k, lpad(lower(to_hex(pos // 16 * 16)), 8, '0') || ': ' || rpad(coalesce(string_agg(h || ' ', '' order by pos) filter (pos % 16 < 8), ''), 24, ' ') || ' '
            || rpad(coalesce(string_agg(h || ' ', '' order by pos) filter (pos % 16 >= 8), ''), 24, ' ') || ' |' || string_agg(c, '' order by pos) || '|' as line from cells group by 1, 2)
        select artifact_id, string_agg(line, chr(10) order by k) as dump from lines group by 1""",
    "capped_instructions": f"with {INSTRUCTIONS} select function_addr, count(*) as n, max(idx) as last from instructions where idx < 20 group by 1",
    "split_instructions": f"with {INSTRUCTIONS} select mnemonic, operands, count(*) as n from instructions group by 1, 2",
    "call_graph_dot": f"""with {CALLS}, n as (select address, '  "0x' || lower(to_hex(address)) || '" [label="' || name || '\\n0x' || lower(to_hex(address)) || '", fillcolor="' || case when address = (select address from entry) or name in {_in(ENTRY_NAMES)}
            then 'lightgreen' when {_library} then 'lightblue' else 'lightgray' end || '"];' as line from nodes qualify row_number() over (order by address) <= 1000),
        m as (select caller, callee, call_type, count(*) as k from edges where caller in (select address from n) and callee in (select address from n) group by 1, 2, 3),
        e as (select *, '  "0x' || lower(to_hex(caller)) || '" -> "0x' || lower(to_hex(callee)) || '" [label="' || k || '"' || case call_type when 'Recursive' then ', color=green, style=bold' else '' end || '];' as line from m)
        select 'a' as artifact_id, concat('digraph CallGraph {{', chr(10), '  rankdir=TB;', chr(10), '  node [shape=box, style=filled];', chr(10), '  edge [arrowhead=normal];', chr(10), chr(10), (select string_agg(line, chr(10) order by address) from n), chr(10), chr(10),
            (select string_agg(line, chr(10) order by caller, callee, call_type) from e), chr(10), '}}', chr(10)) as dot""",
    "call_graph_json": f"""with {CALLS}, sites as (select e.user_id as caller, f.user_id as callee, case when e.user_id = f.user_id then 'Recursive' else 'Direct' end as call_type, e.event_id as site from events e join events f on f.event_id = e.event_id + 1 where e.event_type = 'click')
        select 'a' as artifact_id, concat('{{"nodes":[', (select string_agg(concat('{{"address":', address, ',"name":"', name, '"}}'), ',' order by address) from nodes), '],"edges":[',
            (select string_agg(concat('{{"caller":', caller, ',"callee":', callee, ',"call_type":"', call_type, '","site":', site, '}}'), ',' order by caller, callee, call_type, site) from sites), ']}}') as json""",
}
