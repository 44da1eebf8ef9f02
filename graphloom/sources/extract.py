"""From source text to a property graph: one pass over each file by itself, by tables of patterns for each language.

A language is a row of SPECS: patterns of its owners, functions and state variables, how visibility is written, how state is
written, and detectors. Files are read in batches on the executors; nodes, edges and state transitions come out as tagged rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.traverse import cut
from graphloom.sources.store import Graph
from graphloom.sources.walk import extractors

# What is no call, and words that hint at access checks, validation, time, transfers and calls across a boundary.
NO_CALLS = frozenset("Ok Err Some define-public define-private define-read-only define-map define-data-var define-constant try! unwrap! asserts! if for while switch catch return require assert let const var function new typeof sizeof match else try begin ok err some none and or not emit revert".split())
ACCESS = ("onlyowner", "only_owner", "owner", "admin", "authority", "auth", "permission", "role", "has_role", "msg.sender", "tx-sender", "contract-caller", "ctx.sender", "signer", "require_auth")
VALIDATION = ("assert", "require", "ensure", "abort", "raise", "throw", "revert", "try!", "unwrap!", "asserts!", "Validate", "validate", "check")
TIME = ("block.timestamp", "block.number", "block-height", "burn-block-height", "get_block_timestamp", "timestamp", "Clock", "SYSVAR_CLOCK")
BOUNDARY = frozenset("raw_call send transfer public_transfer stx-transfer? ft-transfer? nft-transfer? sendTransaction sendAndConfirmTransaction signAndSendTransaction call_contract_syscall library_call_syscall".split())
SPECIAL = {"constructor", "fallback", "receive"}

CALL = re.compile(r"([A-Za-z_$][\w$]*(?:(?:::|\.)[A-Za-z_$][\w$]*)*)\s*(?:\{[^{}]*\}\s*)?\(")
CLARITY_CALL = re.compile(r"\(\s*([A-Za-z][\w\-!?]*)")


@dataclass(frozen=True)
class Spec:
    """owner, function and state: patterns with a group `name`; function may have `params`, `mods` and `vis`."""

    function: str
    owner: str = ""
    state: str = ""
    comments: str = r"//[^\n]*|/\*.*?\*/"
    public: str = r"\b(public|external|pub|entry|export)\b"
    body: str = "braces"
    write: str = r"(?<![\w.]){v}(?:\[[^\]]*\]|\.\w+)*\s*(?:[-+*/|&^]?=(?!=)|\+\+|--)|(?<![\w.]){v}\.(?:push|pop|set|insert|remove|save)\b"
    modifier: str = ""
    event: str = ""
    call: re.Pattern = CALL
    detectors: tuple = ()
    self_prefix: str = ""
    default_public: bool = False
    extra: dict = field(default_factory=dict)


def found(pattern: str, flags: int = 0):
    """A detector: the distinct texts that match."""
    compiled = re.compile(pattern, flags)
    return lambda f: list(dict.fromkeys(m.group(m.lastindex or 0) for m in compiled.finditer(f["body"])))


def flag(pattern: str, unless: str = ""):
    """A detector: true if the pattern matches and the other does not."""
    yes, no = re.compile(pattern), re.compile(unless) if unless else None
    return lambda f: bool(yes.search(f["body"])) and not (no and no.search(f["body"]))


def typed(*rules: tuple[str, str, str]):
    """A detector: (type, pattern, pattern that excuses it) -> [{type, line}]."""
    compiled = [(t, re.compile(y, re.S), re.compile(n) if n else None) for t, y, n in rules]
    return lambda f: [{"type": t, "line": f["line"] + f["body"].count("\n", 0, m.start())} for t, y, n in compiled if (m := y.search(f["body"])) and not (n and n.search(f["body"]))]


def named(pattern: str, unless: str, *names: str):
    """A detector: the names, if the pattern matches and the other does not."""
    yes, no = re.compile(pattern), re.compile(unless) if unless else None
    return lambda f: list(names) if yes.search(f["body"]) and not (no and no.search(f["body"])) else []


_LOOP = r"\b(?:for|while|loop)\b[^{]*\{"
_CRYPTO = (("weak_crypto", found(r"\b(md5|sha1|MD5|SHA1|SHA-1|DES|RC4|ECB)\b")),)
_KEYS = (("private_key_material", flag(r"(?i)private_?key|mnemonic|fromSeed|secret_?key")),)
_EVM = (
    ("timestamp_dependence", found(r"(block\.timestamp|block\.number|\bnow\b)")),
    ("unchecked_erc20", found(r"(?m)^\s*\w+(?:\([^()]*\))?\.(transfer|transferFrom|approve)\s*\([^;]*\)\s*;")),
    ("unchecked_calls", found(r"(?m)^\s*[\w.()]+\.(call|send|delegatecall|staticcall)\s*(?:\{[^}]*\})?\(")),
    ("oracle_risk", found(r"\b(getReserves|latestAnswer|slot0|balanceOf)\s*\(")),
    ("signature_risk", lambda f: "ecrecover_without_nonce" if "ecrecover" in f["body"] and not re.search(r"nonce|chainid|DOMAIN", f["body"], re.I) else ""),
    ("precision_risk", flag(r"\w\s*/\s*[\w.()]+\s*\*")),
    ("dos_risk", typed(("unbounded_loop", r"\bfor\b[^{]*\.length[^{]*\{", ""), ("external_call_in_loop", _LOOP + r"[^}]*\.(?:call|transfer|send)\b", ""))),
    ("frontrun_risk", found(r"\.(approve)\s*\(", 0)),
    ("unsafe_downcast", found(r"\b(u?int(?:8|16|32|64|96|128))\s*\(\s*[a-z_]\w*")),
    ("flash_loan_risk", lambda f: ["state_write_in_callback"] if re.match(r"(onFlashLoan|executeOperation|uniswapV2Call|uniswapV3FlashCallback)$", f["name"]) else []),
    ("slippage_risk", lambda f: ["no_min_out"] * bool(re.search(r"(?i)^swap|addLiquidity|removeLiquidity", f["name"]) and not re.search(r"(?i)min\w*(out|amount)|amountOutMin", f["params"] + f["body"])) + ["no_deadline"] * bool(re.search(r"(?i)^swap|addLiquidity|removeLiquidity", f["name"]) and "deadline" not in f["params"] + f["body"])),
    ("erc_callback_risk", lambda f: [f["name"]] if re.match(r"on(ERC721Received|ERC1155Received|ERC1155BatchReceived)$|tokensReceived$", f["name"]) else []),
    ("proxy_risk", lambda f: "delegatecall" if "delegatecall" in f["body"] else ""),
    ("upgrade_surface", flag(r"upgradeTo|_setImplementation|_authorizeUpgrade")),
    ("privileged_operations", found(r"\b(selfdestruct|_mint|_burn|setOwner|transferOwnership|pause|unpause)\b\s*\(")),
    ("uses_tx_origin", flag(r"tx\.origin")),
    ("has_assembly", flag(r"\bassembly\b")),
    ("has_unchecked", flag(r"\bunchecked\b")),
    ("unchecked_arithmetic", found(r"\bunchecked\s*\{([^}]*[-+*][^}]*)\}")),
    ("role_guards", found(r"require\s*\(\s*(msg\.sender\s*==\s*\w+|\w+\s*==\s*msg\.sender|hasRole\([^)]*\))")),
    ("dead_params", lambda f: [n for n in re.findall(r"(\w+)\s*(?:,|$)", f["params"]) if f["body"].strip("{} \n") and not re.search(rf"\b{n}\b", f["body"])]),
)
_RUST = (
    ("unsafe_blocks", lambda f: len(re.findall(r"\bunsafe\s*\{", f["body"]))),
    ("unsafe_operations", found(r"\b(transmute|from_raw_parts(?:_mut)?|get_unchecked(?:_mut)?|read_volatile|write_volatile|zeroed)\b")),
    ("panic_paths", found(r"(\.unwrap\(\)|\.expect\(|\bpanic!|\bunreachable!|\btodo!|\bunimplemented!)")),
    ("wrapping_arithmetic", found(r"\.((?:wrapping|overflowing)_\w+)\(")),
    ("raw_pointers", flag(r"\*(?:const|mut)\s+\w")),
    ("is_unsafe_fn", lambda f: "unsafe" in f["mods"]),
    ("crypto_concerns", found(r"\b(thread_rng|md5|sha1)\b")),
)
_ANCHOR = (
    ("context_type", lambda f: (re.findall(r"Context<[^A-Z>]*([A-Z]\w*)", f["params"]) or [""])[-1]),
    ("cpi_calls", found(r"\b(invoke(?:_signed)?|CpiContext::new(?:_with_signer)?)\b")),
)
# Hooks of a pallet and those that migrate; kinds of storage, the first that is found; tiers of storage with their calls; functions for administrators.
HOOKS = ("on_initialize", "on_finalize", "on_idle", "offchain_worker", "integrity_test", "on_runtime_upgrade", "pre_upgrade", "post_upgrade")
MIGRATIONS = ("on_runtime_upgrade", "pre_upgrade", "post_upgrade")
STORAGE_KINDS = ("StorageDoubleMap", "CountedStorageMap", "StorageMap", "StorageValue")
TIERS = ("instance", "persistent", "temporary")
TIER_CALLS = {"reads": ("get", "has", "contains_key"), "writes": ("set", "remove", "update"), "ttl": ("extend_ttl",)}
ADMIN = re.compile(r"(?i)(set_admin|upgrade|pause|unpause|mint|clawback|set_fee|set_oracle|set_config|emergency|freeze|update_current_contract_wasm|initialize)$")
_TIER = re.compile(rf"\.({'|'.join(TIERS)})\(\)\s*\.\s*({'|'.join(c for calls in TIER_CALLS.values() for c in calls)})\s*\(\s*&?(\w+(?:::\w+)?)?")


def _storage_ops(f: dict) -> dict:
    """{tier: {reads, writes or ttl: calls}} of a function."""
    ops: dict = {}
    for tier, call, _ in _TIER.findall(f["body"]):
        kind = next(k for k, calls in TIER_CALLS.items() if call in calls)
        calls = ops.setdefault(tier, {}).setdefault(kind, [])
        if call not in calls:
            calls.append(call)
    return ops


def _storage_facts(line: str) -> dict:
    """What kind a pallet's storage is of, and whether its values may grow without bound."""
    kind = next((k for k in STORAGE_KINDS if k in line), "")
    grows = re.search(r"(?<!Bounded)(?:(?:Vec|BTreeMap|BTreeSet|HashMap|HashSet)<|String\s*[,>])", line)
    return ({"storage_type": kind} if kind else {}) | ({"unbounded": True} if kind and grows else {})


_SUBSTRATE = (("hook_type", lambda f: f["name"] if f["name"] in HOOKS else ""), ("is_migration", lambda f: f["name"] in MIGRATIONS), ("origin_checks", found(r"\b(ensure_signed|ensure_root|ensure_none)\b")), ("transfer_sinks", found(r"(?:Currency|T::Currency)::(transfer|deposit_creating|slash)\b")), ("cross_contract_calls", found(r"\b(T::\w+::\w+)\(")))
_SOROBAN = (
    ("storage_ops", _storage_ops),
    ("soroban_risks", typed(("missing_auth", r"storage\(\)\.\w+\(\)\.set", r"require_auth"), ("unsafe_unwrap", r"\.unwrap\(\)", ""), ("unsafe_expect", r"\.expect\(", ""), ("unstructured_panic", r"\bpanic!\(", ""), ("unbounded_loop", r"\bwhile\b|\bloop\b", ""), ("insecure_prng", r"\.prng\(\)", ""), ("timestamp_randomness", r"timestamp\(\)\s*%", ""), ("unprotected_upgrade", r"update_current_contract_wasm", r"require_auth"), ("missing_extend_ttl", r"persistent\(\)\.set", r"extend_ttl"), ("unbounded_instance_storage", r"(?=.*instance\(\)\.set).*\bVec\b.*\.push_back\(", ""))),
    ("cross_contract_calls", found(r"\b(invoke_contract|\w+Client::new)\b")),
)
_C = (
    ("buffer_overflow_risk", found(r"\b(strcpy|strcat|gets|sprintf|vsprintf|memcpy|scanf)\s*\(")),
    ("format_string_risk", found(r"\b((?:f|s|sn)?printf)\s*\(\s*(?:\w+\s*,\s*)?[a-z_]\w*\s*\)")),
    ("command_injection_risk", found(r"\b(system|popen|execl|execlp|execvp)\s*\(\s*[a-z_]\w*")),
    ("use_after_free_risk", lambda f: list(dict.fromkeys(m[1] for m in re.finditer(r"\bfree\s*\(\s*(\w+)\s*\)\s*;", f["body"]) if re.search(rf"\b{m[1]}\s*(?:->|\[)", re.split(rf"\b{m[1]}\s*=[^=]", f["body"][m.end() :])[0])))),
    ("double_free_risk", lambda f: [v for v in dict.fromkeys(re.findall(r"\bfree\s*\(\s*(\w+)\s*\)", f["body"])) if re.search(rf"free\s*\(\s*{v}\s*\)(?:(?!\b{v}\s*=[^=]).)*free\s*\(\s*{v}\s*\)", f["body"], re.S)]),
    ("null_deref_risk", lambda f: [m[1] for m in re.finditer(r"(\w+)\s*=\s*(?:\([^)]*\)\s*)?(?:malloc|calloc|realloc)\s*\(", f["body"]) if not re.search(rf"if\s*\(\s*!?\s*{m[1]}\b", f["body"])]),
    ("toctou_risk", typed(("access_then_open", r"\b(?:access|stat)\s*\(.*?\b(?:open|fopen)\s*\(", ""))),
    ("path_traversal_risk", found(r"\b(fopen|open)\s*\(\s*[a-z_]\w*\s*,")),
    ("integer_overflow_risk", found(r"\b(?:malloc|calloc)\s*\(\s*(\w+\s*\*\s*\w+)")),
    ("uninitialized_use", lambda f: [m[1] for m in re.finditer(r"(?m)^\s*(?:int|char|long|float|double|size_t)\s+(\w+)\s*;", f["body"]) if re.search(rf"\breturn\s+{m[1]}\b", f["body"]) and not re.search(rf"\b{m[1]}\s*=[^=]|&{m[1]}\b", f["body"])]),
    ("dangerous_calls", found(r"\b(alloca|setuid|chmod|mktemp|strtok)\s*\(")),
)
_GO = (
    ("unchecked_errors", found(r"(?m)^\s*(?:_\s*=\s*|\w+\s*,\s*_\s*:?=\s*)([\w.]+)\(")),
    ("unsafe_type_assertions", found(r"(?m)^\s*\w+\s*:?=\s*(\w+\.\(\*?[\w.]+\))")),
    ("sql_injection_risk", found(r"(?:Query|Exec|QueryRow)\w*\(\s*(fmt\.Sprintf|\"[^\"]*\"\s*\+)")),
    ("potential_race", lambda f: {"shared_fields": sorted(set(re.findall(r"\b(\w+\.\w+)\s*(?:=[^=]|\+\+)", f["body"]))), "goroutine_line": f["line"] + f["body"].count("\n", 0, f["body"].find("go func"))} if "go func" in f["body"] and not re.search(r"Lock\(\)|atomic\.", f["body"]) else {}),
    ("transfer_sinks", found(r"\b(SendCoins\w*|MintCoins|BurnCoins)\b")),
    ("channels", lambda f: len(re.findall(r"<-|make\(chan", f["body"]))),
)
_JAVA = (
    ("deserialization_sinks", found(r"\b(readObject|readUnshared|XMLDecoder|enableDefaultTyping)\b")),
    ("reflection_usage", found(r"\b(Class\.forName|getDeclaredMethod|setAccessible|newInstance)\b")),
    ("injection_sinks", found(r"\b(Runtime\.getRuntime\(\)\.exec|ProcessBuilder|executeQuery|createQuery|ScriptEngine)\b")),
    ("swallowed_exceptions", lambda f: len(re.findall(r"catch\s*\([^)]*\)\s*\{\s*\}", f["body"]))),
    ("resource_leaks", lambda f: [] if "try (" in f["body"] else list(dict.fromkeys(re.findall(r"new\s+(\w*(?:InputStream|OutputStream|Reader|Writer|Socket))\b", f["body"])))),
    ("potential_race", lambda f: {"shared_fields": sorted(set(re.findall(r"this\.(\w+)\s*=[^=]", f["body"])))} if re.search(r"new Thread|executor|CompletableFuture", f["body"]) and "synchronized" not in f["body"] else {}),
    ("unsafe_memory", flag(r"sun\.misc\.Unsafe|Unsafe\.")),
    *_CRYPTO,
)
_SCRIPT = (
    ("command_injection_risk", found(r"\b(os\.system|subprocess\.\w+|child_process\.\w+|execSync|exec|eval)\s*\(")),
    ("deserialization_sinks", found(r"\b(pickle\.loads?|yaml\.load|marshal\.loads|JSON\.parse)\b")),
    ("sql_injection_risk", found(r"\.(execute|query)\s*\(\s*(?:f[\"']|[\"'`][^\"'`]*[\"'`]\s*[+%]|`[^`]*\$\{)")),
    *_CRYPTO,
    *_KEYS,
)
_TRANSFERS = (("transfer_sinks", found(r"((?:public_)?transfer|stx-transfer\?|ft-transfer\?|nft-transfer\?|raw_call|sendTransaction|sendAndConfirmTransaction|mint|burn)\b")), ("timestamp_dependence", found("(" + "|".join(map(re.escape, TIME)) + ")")))

_C_STATE = r"(?m)^\s*(?:static\s+)?(?:std::)?[\w:<>]+[\s*&]+(?P<name>\w+)\s*(?:=[^;(]*)?;"
SPECS: dict[str, Spec] = {
    "solidity": Spec(
        r"\b(?:function\s+(?P<name>\w+)|(?P<special>constructor|fallback|receive))\s*\((?P<params>[^)]*)\)(?P<mods>[^{};]*)(?=[{;])", r"\b(?P<kind>contract|interface|library|abstract\s+contract)\s+(?P<name>\w+)(?:\s+is\s+(?P<bases>[^{]+))?\s*\{",
        r"(?m)^\s*(?:mapping\s*\([^;]*\)|[A-Za-z_][\w.]*(?:\[[^\]]*\])*)\s+(?:(?:public|private|internal|constant|immutable|override)\s+)*(?P<name>\w+)\s*(?:=[^;]*)?;", modifier=r"\bmodifier\s+(?P<name>\w+)", event=r"\bemit\s+(?P<name>\w+)", detectors=_EVM,
    ),
    "vyper": Spec(r"(?m)^def\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)(?P<mods>[^:]*):", state=r"(?m)^(?P<name>\w+)\s*:\s*(?:public\()?\w", comments=r"#[^\n]*", public=r"@(external|public)", body="indent", self_prefix="self.", event=r"\blog\s+(?P<name>\w+)", detectors=(*_TRANSFERS, ("unchecked_calls", found(r"(raw_call)\([^)]*revert_on_failure\s*=\s*False")), ("signature_risk", lambda f: "ecrecover" if "ecrecover" in f["body"] and "nonce" not in f["body"] else ""))),
    "move": Spec(r"(?P<mods>(?:public(?:\([^)]*\))?\s+|entry\s+)*)fun\s+(?P<name>\w+)[^(]*\((?P<params>[^)]*)\)[^{;]*(?=[{;])", r"\b(?P<kind>module)\s+(?P<name>[\w:]+)", r"\bstruct\s+(?P<name>\w+)[^{]*\bkey\b", write=r"(?:move_to|move_from|borrow_global_mut)\s*(?:<\s*{v})", event=r"event::emit\w*\(\s*(?P<name>\w+)", detectors=(*_TRANSFERS, ("move_entry", lambda f: "entry" in f["mods"]))),
    "clarity": Spec(r"\(define-(?P<mods>public|private|read-only)\s+\((?P<name>[\w\-!?]+)(?P<params>[^\n]*)", state=r"\(define-(?:data-var|map)\s+(?P<name>[\w\-!?]+)", comments=r";;[^\n]*", body="parens", write=r"\((?:var-set|map-set|map-insert|map-delete)\s+{v}\b", call=CLARITY_CALL, detectors=(*_TRANSFERS, ("view", lambda f: f["mods"] == "read-only"), ("cross_contract_calls", found(r"\((contract-call\?)")))),
    "cairo": Spec(r"(?P<mods>(?:pub\s+)?)fn\s+(?P<name>\w+)[^(]*\((?P<params>[^)]*)\)[^{;]*(?=[{;])", r"\b(?P<kind>mod|trait|impl)\s+(?P<name>\w+)", r"(?m)^\s{4,}(?P<name>\w+)\s*:\s*(?:felt252|u\d+|bool|Contract\w*|Map<|LegacyMap|StoragePointer)", public=r"\bpub\b|external", write=r"self\.{v}\.(?:write|entry)", self_prefix="self.", event=r"emit\(\s*(?P<name>\w+)", detectors=(*_TRANSFERS, ("cross_contract_calls", found(r"\b(call_contract_syscall|library_call_syscall)\b")))),
    "sway": Spec(r"(?P<mods>(?:pub\s+)?)fn\s+(?P<name>\w+)[^(]*\((?P<params>[^)]*)\)[^{;]*(?=[{;])", r"\b(?P<kind>contract|library|abi|impl)\s+(?P<name>\w+)", r"(?m)^\s+(?P<name>\w+)\s*:\s*(?:u\d+|bool|b256|StorageMap)[^=\n]*=", write=r"storage\.{v}\.(?:write|insert|remove)", detectors=_TRANSFERS),
    "ton": Spec(r"(?m)^\s*(?:[\w()\s,]*?\s)?(?:fun\s+|receive\s*)?(?P<name>[a-z_]\w*)\s*\((?P<params>[^)]*)\)(?P<mods>[^{};]*)(?=\{)", r"\b(?P<kind>contract|trait)\s+(?P<name>\w+)", r"(?m)^\s*(?:global\s+\w+\s+|)(?P<name>\w+)\s*:\s*(?:Int|Bool|Address|map)", comments=r";;[^\n]*|//[^\n]*", write=r"(?:\bself\.|(?<![\w.])){v}(?:\[[^\]]*\])?\s*(?:[-+*/]?=(?!=))", public=r"method_id|\bget\b|receive|recv_", detectors=(*_TRANSFERS, ("ton_accept_message", flag(r"accept_message|acceptMessage")), ("ton_validation", flag(r"throw_unless|throw_if|require\(")), ("ignored_bounce", flag(r"send_raw_message|send\(", r"bounce")))),
    "proto": Spec(r"\brpc\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)\s*returns\s*\((?P<mods>[^)]*)\)", r"\b(?P<kind>service|message|enum)\s+(?P<name>\w+)\s*\{", body="line", default_public=True, detectors=(("streaming_rpc", lambda f: "stream" in f["params"] + f["mods"]), ("auth_boundary", lambda f: bool(re.search(r"(?i)auth|login|token|admin|withdraw|transfer", f["name"]))))),
    "xdr": Spec(r"\b(?P<name>\w+)\s+\w+\s*\((?P<params>[^)]*)\)\s*=\s*\d+", r"\b(?P<kind>struct|union|enum)\s+(?P<name>\w+)", body="line"),
    "typescript": Spec(r"(?P<mods>(?:export\s+|async\s+|public\s+|private\s+|static\s+)*)(?:function\s+(?P<name>\w+)|(?:const|let)\s+(?P<arrow>\w+)\s*=\s*(?:async\s*)?(?=\([^)]*\)\s*(?::[^=]+)?=>))\s*\((?P<params>[^)]*)\)[^{;]*(?=\{)", r"\b(?P<kind>class|interface)\s+(?P<name>\w+)", r"(?m)^\s*(?:private|public|protected)\s+(?P<name>\w+)\s*[:=]", self_prefix="this.", detectors=_SCRIPT),
    "python": Spec(r"(?m)^(?P<indent>[ \t]*)(?:async\s+)?def\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)(?P<mods>[^:]*):", r"(?m)^(?P<kind>class)\s+(?P<name>\w+)", comments=r"#[^\n]*", body="indent", self_prefix="self.", default_public=True, detectors=_SCRIPT),
    "go": Spec(r"\bfunc\s+(?:\(\s*\w+\s+\*?(?P<recv>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*\((?P<params>[^)]*)\)(?P<mods>[^{]*)(?=\{)", r"\btype\s+(?P<name>\w+)\s+(?P<kind>struct|interface)\s*\{", r"(?m)^\t(?P<name>[A-Za-z]\w*)\s+[\w.*\[\]]+", write=r"\b\w+\.{v}(?:\[[^\]]*\])?\s*(?:[-+*/]?=(?!=)|\+\+|--)", detectors=_GO),
    "java": Spec(r"(?P<mods>(?:(?:public|private|protected|static|final|synchronized|native|abstract)\s+)+)[\w<>\[\],\s]+?\s(?P<name>\w+)\s*\((?P<params>[^)]*)\)[^{;]*(?=[{;])", r"\b(?P<kind>class|interface|enum)\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>\w+))?", r"(?m)^\s*(?:(?:public|private|protected|static|final|volatile)\s+)+[\w<>\[\],\s]+?\s(?P<name>\w+)\s*(?:=[^;]*)?;", self_prefix="this.", detectors=_JAVA),
    "cpp": Spec(r"(?m)^[ \t]*(?P<mods>(?:static|inline|virtual|extern|unsigned|const)\s+)*(?:[\w:<>]+[\s*&]+)(?:(?P<recv>\w+)::)?(?P<name>~?\w+)\s*\((?P<params>[^)]*)\)[^{;]*(?=\{)", r"\b(?P<kind>class|struct|namespace|enum)\s+(?P<name>\w+)(?:\s*:\s*(?:public|private|protected)\s+(?P<bases>\w+))?\s*\{", _C_STATE, default_public=True, detectors=_C),
    "rust": Spec(r"(?P<mods>(?:pub(?:\([^)]*\))?\s+|unsafe\s+|async\s+|extern\s+(?:\"C\"\s+)?|const\s+)*)fn\s+(?P<name>\w+)[^(]*\((?P<params>[^)]*)\)[^{;]*(?=[{;])", r"\b(?P<kind>struct|enum|trait|impl|mod)\s+(?:<[^>]*>\s*)?(?P<name>\w+)", r"(?m)^\s+(?:pub\s+)?(?P<name>\w+)\s*:\s*[\w<>:&]+,", write=r"self\.{v}(?:\[[^\]]*\])?\s*(?:[-+*/]?=(?!=))|self\.{v}\.(?:push|insert|remove|clear|set)\b", detectors=_RUST),
}
_rust = SPECS["rust"]
for _lang, _more, _event in (("anchor", _ANCHOR, r"emit!\s*\(\s*(?P<name>\w+)"), ("substrate", _SUBSTRATE, r"deposit_event\(\s*(?:Event::)?(?P<name>\w+)"), ("soroban", _SOROBAN, r"\.publish\(\s*\(?\s*(?P<name>\w+)")):
    SPECS[_lang] = Spec(_rust.function, _rust.owner, r"(?m)^\s+(?:pub\s+)?(?P<name>\w+)\s*:\s*(?:Account<|Program<|u\d+|i\d+|bool|Pubkey|Address)|type\s+(?P<alias>\w+)<T[^=]*=\s*Storage", write=r"(?:\.|\b){v}(?:\[[^\]]*\])?\s*(?:[-+*/]?=(?!=))|{v}::<T>::(?:put|insert|mutate|remove|kill)", event=_event, detectors=(*_RUST, *_more))
SINKS = (
    ("fund_transfer", re.compile(r"\.(transfer|send)\s*\(|\{value:|\bsend_raw_message\b|SendCoins")), ("low_level_call", re.compile(r"\.(call)\s*[({]")), ("static_call", re.compile(r"\.(staticcall)\s*\(")), ("delegate", re.compile(r"\.(delegatecall)\s*\(")),
    ("self_destruct", re.compile(r"\b(selfdestruct)\s*\(")), ("unsafe_ffi", re.compile(r"\b(transmute)\b")), ("cpi_transfer", re.compile(r"\b(invoke_signed|invoke)\s*\(")),
)


def _end_of(text: str, at: int, kind: str) -> int:
    """Where the body that begins at `at` ends."""
    if kind == "line":
        return (text + "\n").find("\n", at)
    if kind == "indent":
        line = text.rfind("\n", 0, at) + 1
        own = len(text[line:]) - len(text[line:].lstrip(" \t"))
        for m in re.finditer(r"\n([ \t]*)(?=\S)", text[at:]):
            if len(m[1]) <= own:
                return at + m.start()
        return len(text)
    opener, closer = ("(", ")") if kind == "parens" else ("{", "}")
    depth, i, quote = 0, at, ""
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote or c == "\n":
                quote = ""
        elif c == '"' or c == "`":
            quote = c
        elif c == opener:
            depth += 1
        elif c == closer:
            depth -= 1
            if depth <= 0:
                return i + 1
        elif c == ";" and depth == 0 and kind == "braces":
            return i + 1
        i += 1
    return len(text)


def _decorators(text: str, at: int) -> str:
    """The lines right above that begin with @ or #[."""
    out = []
    for line in reversed(text[: text.rfind("\n", 0, at) + 1].splitlines()):
        if not line.strip().startswith(("@", "#[")):
            break
        out.append(line.strip())
    return " ".join(out)


#: Writes that read first.
_UPDATES = re.compile(r"(?:[-+*/|&^]=|\+\+|--|\b(?:mutate|push|pop|entry|insert|remove|borrow_global_mut\W*<?\W*\w*|move_from\W*\w*))$")
# Calls of a key-value store with what they do to an entity, and the words of its conditions.
STORE_CALLS = {"Set": ("*", "exists"), "Delete": ("exists", "deleted"), "Get": ("exists", "exists")}
_STORE = re.compile(r"\.(Set|Delete|Get)\s*\([^;\n]{0,40}?\btypes\.(\w+?)(?:KeyPrefix|Key)\b")
_ACCOUNT = re.compile(r"(?P<attrs>(?:#\[(?:[^\[\]]|\[[^\]]*\])*\]\s*)*)(?:pub\s+)?(?P<name>[a-z_]\w*)\s*:(?!:)(?P<type>[^\n]*)")


def _accounts(body: str) -> dict:
    """What a struct of accounts asks of them: by field, and as access controls, seeds and targets on close."""
    meta: dict = {"is_accounts_context": True, "fields": [], "access_controls": [], "pda_fields": {}, "close_targets": {}, "field_metadata": {}}
    for m in _ACCOUNT.finditer(body):
        attrs = " ".join(re.findall(r"account\(.*", m["attrs"], re.S))
        kind = re.search(r"\b(AccountInfo|UncheckedAccount|Signer|Account)\b", m["type"])
        field: dict = {"mutable": True} if re.search(r"\bmut\b", attrs) else {}
        if kind and kind[1] in ("AccountInfo", "UncheckedAccount"):
            field["unchecked_account"] = True
        elif kind:
            field["account_type"] = kind[1]
        if owner := re.search(r"\bowner\s*=\s*(\w+)", attrs):
            field["owner_check"] = owner[1]
        meta["fields"].append(m["name"])
        meta["field_metadata"] |= {m["name"]: field} if field else {}
        meta["access_controls"] += [f"has_one:{x}" for x in re.findall(r"has_one\s*=\s*(\w+)", attrs)]
        if seeds := re.search(r"seeds\s*=\s*\[([^\]]+)\]", attrs):
            meta["pda_fields"][m["name"]] = {"pda_seeds": [x.strip() for x in seeds[1].split(",") if x.strip()], "has_bump": bool(re.search(r"\bbump\b", attrs))}
        if close := re.search(r"\bclose\s*=\s*(\w+)", attrs):
            meta["close_targets"][m["name"]] = close[1]
    return {k: v for k, v in meta.items() if v or k == "fields"}


def _owner_facts(lang: str, kind: str, body: str, head: str) -> dict:
    """What an owner tells by itself: the methods an interface asks for, the constants of an enum, the accounts of a context."""
    if lang == "go" and kind == "interface":
        return {"methods": re.findall(r"(?m)^\s*([A-Za-z_]\w*)\s*\(", body)}
    if lang == "java" and kind == "enum":
        constants = re.split(r";", re.sub(r"\([^()]*\)|\{[^{}]*\}", "", body.rstrip().removesuffix("}")))[0]
        return {"kind": "enum", "variants": re.findall(r"(?:^|,)\s*(?:@\w+\s+)*([A-Za-z_]\w*)", constants)}
    if lang == "anchor" and kind == "struct" and re.search(r"derive\([^)]*\bAccounts\b", head):
        return _accounts(body)
    return {}


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def extract(path: str, source: str, lang: str) -> tuple[list[dict], list[dict], list[dict]]:
    """(nodes, edges, transitions) of one file."""
    spec = SPECS.get(lang)
    if spec is None:
        return [], [], []
    text = re.sub(spec.comments, _blank, source, flags=re.S)
    line_of = lambda at: text.count("\n", 0, at) + 1
    nodes: list[dict] = []
    edges: list[dict] = []
    moves: list[dict] = []

    def node(i, label, kind, at, end, visibility="", signature="", meta=None):
        nodes.append({"id": i, "label": label, "type": kind, "visibility": visibility, "file": path, "line_start": line_of(at), "line_end": line_of(max(at, end - 1)), "signature": signature, "metadata": json.dumps({"language": lang} | (meta or {}))})

    def edge(s, t, relation, **attributes):
        edges.append({"source": s, "target": t, "relation": relation, "attributes": json.dumps(attributes)})

    owners = []
    for m in re.finditer(spec.owner, text) if spec.owner else ():
        end = _end_of(text, m.end() - 1 if text[m.end() - 1 : m.end()] == "{" else m.end(), "indent" if spec.body == "indent" else "braces")
        name, kind = m["name"], re.sub(r"\s+contract", "", m["kind"])
        owners.append((m.start(), end, name))
        facts = _owner_facts(lang, kind, text[m.end() : end].partition("{")[2] if text[m.end() - 1 : m.end()] != "{" else text[m.end() : end - 1], _decorators(text, m.start()))
        if kind != "impl":
            node(f"{path}::{name}", name, kind, m.start(), end, meta=facts)
        if len(facts.get("variants", ())) > 1 and "/test/" not in f"/{path}":
            moves += [{"entity": name, "from_state": "*", "to_state": v, "function_id": f"{path}::{name}", "conditions": '["enum_value"]'} for v in facts["variants"]]
        for base in re.findall(r"\w+", m.groupdict().get("bases") or ""):
            edge(f"{path}::{name}", f"_::{base}", "inherits")

    def owner_at(at):
        inside = [o for o in owners if o[0] < at < o[1]]
        return min(inside, key=lambda o: o[1] - o[0])[2] if inside else ""

    full = lambda owner, name: f"{path}::{owner}.{name}" if owner else f"{path}::{name}"
    functions = []
    for m in re.finditer(spec.function, text):
        g = m.groupdict()
        name = g.get("name") or g.get("special") or g.get("arrow")
        if name in NO_CALLS:
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        end = _end_of(text, start if spec.body in ("parens",) else m.end(), spec.body)
        params, inner = g.get("params") or "", m.end()
        if spec.body == "parens":
            inner = _end_of(text, text.index("(", start + 1), "parens")
            params = text[m.start("params") : max(m.start("params"), inner - 1)]
        functions.append({"name": name, "params": params, "mods": g.get("mods") or "", "start": start, "end": end, "body": text[inner:end], "line": line_of(start), "owner": g.get("recv") or owner_at(m.start()), "head": _decorators(text, start)})
    spans = [(f["start"], f["end"]) for f in functions]
    states: dict[str, tuple[str, str]] = {}
    for m in re.finditer(spec.state, text) if spec.state else ():
        if any(s <= m.start() < e for s, e in spans):
            continue
        name = m["name"] or m.groupdict().get("alias")
        if not name or name in NO_CALLS or name in states or re.match(r"\s*(return|import|using|package|pragma|emit|delete)\b", m[0]):
            continue
        owner = owner_at(m.start())
        states[name] = (full(owner, name), owner)
        line = text[m.start() : (text + ";").find(";", m.start())] if lang == "substrate" else ""
        node(full(owner, name), name, "state_var", m.start(), m.end(), meta=_storage_facts(line))
        if owner:
            edge(f"{path}::{owner}", full(owner, name), "contains")
    guards = {}
    for m in re.finditer(spec.modifier, text) if spec.modifier else ():
        owner = owner_at(m.start())
        guards[m["name"]] = full(owner, m["name"])
        node(guards[m["name"]], m["name"], "modifier", m.start(), _end_of(text, m.end(), "braces"))
    by_name: dict[str, str] = {}
    for f in functions:
        types = ",".join(p.strip().split()[0] for p in f["params"].split(",") if p.strip()) if lang == "solidity" else ""
        f["id"] = full(f["owner"], f["name"]) + (f"({types})" if lang == "solidity" else "")
        by_name.setdefault(f["name"], f["id"])
    for f in functions:
        body, shown = f["body"], f["mods"] + " " + f["head"]
        open_ = bool(re.search(spec.public, shown)) or spec.default_public and not f["name"].startswith("_") or lang == "go" and f["name"][:1].isupper() or f["name"] in SPECIAL
        visibility = ("external" if "external" in shown else "public") if open_ else ("private" if "private" in shown else "internal")
        if lang == "rust":
            visibility = "pub" if "pub" in f["mods"] else "private"
        meta: dict = {}
        used = [g for g in guards if re.search(rf"\b{re.escape(g)}\b", f["mods"])]
        if used:
            meta["modifiers"] = used
        for word in ("view", "pure", "payable"):
            if re.search(rf"\b{word}\b", f["mods"]):
                meta[word] = True
        for key, detector in spec.detectors:
            if value := detector(f):
                meta[key] = value
        if any(h in body.lower() for h in ACCESS):
            meta["access_controls"] = [h for h in ACCESS if h in body.lower()]
        checked = any(h in body for h in VALIDATION) or used
        if open_ and f["params"].strip() and body.strip("{}; \n") and not checked and f["params"].strip() not in ("&self", "&mut self", "self"):
            meta["no_input_validation"] = True
        touched = {v: target for v, (target, _) in states.items() if re.search(rf"(?<![\w]){re.escape(v)}\b", body)}
        writes, patterns = {}, {}
        for v in touched:
            pattern = spec.write.replace("{v}", (re.escape(spec.self_prefix) + "{v}" if spec.self_prefix and not spec.write.startswith(("self", "\\b")) else "{v}").replace("{v}", re.escape(v)))
            if spec.self_prefix and not spec.write.startswith("self"):
                pattern = pattern.replace("(?<![\\w.])", "")
            patterns[v] = pattern
            if m := re.search(pattern, body):
                writes[v] = max(x.start() for x in re.finditer(pattern, body)) or m.start()
        calls, seen = [], set()
        for m in spec.call.finditer(body):
            name = re.split(r"::|\.", m[1])[-1]
            if name in NO_CALLS or name in seen or name[0].isdigit() or name == f["name"]:
                continue
            seen.add(name)
            calls.append((m.start(), name, "." in m[1] and not m[1].startswith(("self.", "this.", "super."))))
        sinks = [(m.start(), kind, (m.groups() or ("",))[0] or kind) for kind, p in SINKS if (m := p.search(body))]
        order = {at: n for n, at in enumerate(sorted({c[0] for c in calls} | set(writes.values()) | {s[0] for s in sinks}))}
        outside = [at for at, name, foreign in calls if foreign and name not in by_name] + [s[0] for s in sinks]
        if outside and writes and max(writes.values()) > min(outside) and not any("reentran" in g.lower() for g in used) and lang in ("solidity", "vyper"):
            meta["reentrancy_risk"] = True
            meta["reentrancy_details"] = f"state written after a call out in {f['name']}"
        if lang == "soroban" and open_ and "require_auth" not in body:
            exposed = [{"type": "missing_admin_auth", "line": f["line"]}] if ADMIN.match(f["name"]) else []
            keys = [n for n in re.findall(r"(\w+)\s*:", f["params"]) if n not in ("env", "self") and re.search(rf"\.set\s*\([^,]*\b{n}\b", body)]
            exposed += [{"type": "unprotected_storage_key", "line": f["line"]}] * bool(keys)
            if exposed:
                meta["soroban_risks"] = meta.get("soroban_risks", []) + exposed
        if meta.get("cpi_calls") and writes:
            meta["cpi_reentrancy_risk"] = True
        if meta.get("privileged_operations") and not used and "role_guards" not in meta:
            meta["unguarded_privileged_operation"] = True
        node(f["id"], f["name"], "function", f["start"], f["end"], visibility, f"{f['name']}({f['params'].strip()})", meta)
        if f["owner"]:
            edge(f"{path}::{f['owner']}", f["id"], "contains")
        for g in used:
            edge(guards[g], f["id"], "guards")
        for v, target in touched.items():
            if v in writes:
                edge(f["id"], target, "writes_state", order=order[writes[v]])
            assigned = re.sub(rf"(?<![\w.])(?:\w+\.)?{re.escape(v)}\s*=(?!=)", "", body)
            assigned = re.sub(patterns[v], lambda x: x[0] if _UPDATES.search(x[0].rstrip()) else "", assigned)
            if re.search(rf"(?<![\w]){re.escape(v)}\b", assigned):
                edge(f["id"], target, "reads_state")
        for at, name, foreign in calls:
            if name in by_name and not foreign:
                edge(f["id"], by_name[name], "calls", order=order[at])
            elif name in BOUNDARY or "transfer" in name.lower() or name.lower().endswith("call"):
                edge(f["id"], f"_::{name}", "calls", order=order[at], unresolved=True, cross_boundary=True, call_name=name)
            else:
                edge(f["id"], f"_::{name}", "calls", order=order[at], unresolved=True, call_name=name, **({} if foreign else {"internal_candidate": True}))
        for at, kind, label in sinks:
            sink = f"{path}::_sink_{kind}_{f['line']}"
            node(sink, label, "function", f["start"], f["end"], "", "", {"is_sink": True, "sink_type": kind})
            edge(f["id"], sink, "calls", order=order[at], sink=True)
        for m in re.finditer(spec.event, body) if spec.event else ():
            edge(f["id"], f"{path}::{m['name']}", "emits_event")
        for m in re.finditer(r"\b(?:self\.|this\.)?(\w*[sS]tat(?:e|us)\w*)\s*=\s*(\w+)(?:::|\.)(\w+)", body):
            before = re.search(rf"{re.escape(m[1])}\s*==\s*{re.escape(m[2])}(?:::|\.)(\w+)", body[: m.start()])
            moves.append({"entity": f"{path}::{m[2]}", "from_state": before[1] if before else "*", "to_state": m[3], "function_id": f["id"], "conditions": json.dumps(used)})
        for m in _TIER.finditer(body) if lang == "soroban" else ():
            kind = next(k for k, calls in TIER_CALLS.items() if m[2] in calls)
            if kind != "ttl":
                edge(f["id"], f"{path}::_storage_{m[1]}_{m[3] or 'unknown'}", "writes_state" if kind == "writes" else "reads_state", storage_tier=m[1], key=m[3] or "unknown")
        for m in _STORE.finditer(body) if lang == "go" else ():
            conditions = "read" if m[1] == "Get" else "has_validation" if "err != nil" in body else "no_validation"
            moves.append({"entity": m[2], "from_state": STORE_CALLS[m[1]][0], "to_state": STORE_CALLS[m[1]][1], "function_id": f["id"], "conditions": json.dumps([conditions])})
    return nodes, edges, moves


#: Rows of one extractor of a file; those of the next one (Rust, after a dialect) are numbered from here on.
PER_EXTRACTOR = 1 << 22
_ROWS = "kind string, id string, label string, type string, visibility string, file string, line_start int, line_end int, signature string, metadata string, source string, target string, relation string, attributes string, entity string, from_state string, to_state string, function_id string, conditions string, path string, pos int, failure string"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


#: All kinds of rows.
KINDS = ("node", "edge", "transition", "failure")
#: Stands for the path in the rows that files of equal content share; such files are up to so many characters long.
PLACE, SHARED = "\0", 1 << 14


def _tagged(path: str, content: str, lang: str, nth: int, context: str, kinds: tuple[str, ...]) -> list[dict]:
    parts = extract(path, content, lang)
    if context != "production":
        for n in parts[0]:
            n["metadata"] = json.dumps(json.loads(n["metadata"]) | {"source_context": context, "source_kind": "research"})
    return [r | {"kind": kind, "pos": i} for kind, rows in zip(KINDS[:3], parts, strict=True) if kind in kinds for i, r in enumerate(rows, nth * PER_EXTRACTOR)]


@lru_cache(maxsize=64)
def _shared(content: str, lang: str, nth: int, context: str, kinds: tuple[str, ...], place: str) -> list[tuple[dict, list[str]]]:
    """Rows of all files of this content, each with the columns that hold the path's place. Of a path only that matters else whether it lies in a folder of tests."""
    return [(r, [c for c, v in r.items() if isinstance(v, str) and place in v]) for r in _tagged(place, content, lang, nth, context, kinds)]


def _rows(batches: Iterator[pa.RecordBatch], kinds: tuple[str, ...] = KINDS) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.int32() if n in ("line_start", "line_end", "pos") else pa.string()) for n in _NAMES])
    for batch in batches:
        out: list[dict] = []
        for path, content, nth, lang, context in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            content = content or ""
            try:
                if len(content) > SHARED or PLACE in content:
                    rows = _tagged(path, content, lang, nth, context, kinds)
                else:
                    place = f"test/{PLACE}" if "/test/" in f"/{path}" else PLACE
                    rows = [r | {c: r[c].replace(place, path) for c in own} for r, own in _shared(content, lang, nth, context, kinds, place)]
            except Exception as error:  # a file that can't be read is a row of its own, not the end of the build
                if "failure" in kinds:
                    out.append({"kind": "failure", "path": path, "pos": 0, "failure": f"{lang}: {error}"[:300]})
                continue
            out += [r | {"path": path} for r in rows]
        yield pa.RecordBatch.from_pylist(out, schema)


def extracted(files: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Tagged rows of all files, of these kinds. files: (path, content, language, source_context)."""
    each = files.select("path", "content", F.posexplode(extractors(F.col("language"))).alias("nth", "language"), "source_context")
    return each.mapInArrow(partial(_rows, kinds=kinds), _ROWS)


def stored_rows(files: DataFrame) -> DataFrame:
    """extracted(), stored: each file is read once, however many tables are made of its rows."""
    return cut(extracted(files))


def graph_of(rows: DataFrame, order: DataFrame | Column) -> tuple[Graph, DataFrame]:
    """The graph of extracted rows, before the passes over it, and (path, failure) of those that could not be read.

    order: (path, number) of the files, or the number as a function of the path. Rows go by the number of their file and their place in it.
    """
    rows = rows.withColumn("number", order) if isinstance(order, Column) else rows.join(order, "path")
    seq = F.shiftleft(F.col("number"), 24).bitwiseOR(F.col("pos").cast("long"))
    part = lambda kind, names: rows.where(F.col("kind") == kind).select(*names, seq.alias("seq"))
    nodes = part("node", ["id", "label", "type", "visibility", "file", "line_start", "line_end", "signature", "metadata"])
    edges = part("edge", ["source", "target", "relation", "attributes"])
    moves = part("transition", ["entity", "from_state", "to_state", "function_id", "conditions"])
    return Graph.of(nodes, edges, moves), rows.where("kind = 'failure'").select("path", "failure")
