"""Source trees: reading files and telling by their paths what they are, in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.names import name_tokens
from graphloom.functions.payload import ColumnLike, _c
from graphloom.operators.traverse import cut

# Names of directories and files, and extensions, that the classification goes by.
IGNORED_DIRS = (
    "node_modules", "test", "tests", "mock", "mocks", "script", "scripts", "build", "artifacts", "cache", "out", "target", ".git", "__pycache__",
    "lib", "forge-std", ".deps", "__tests__", "__mocks__", "forge-test", "forge-tests", "forge-scripts", "test-utils", "testdata", "testing",
    "fixtures", "fixture", "test-fixtures", "test_fixtures", "poc", "pocs", "demo", "demos", "example", "examples", "sample", "samples",
    "benchmark", "benchmarks", "benches", "fuzz", "fuzzing", "fuzzer", "invariant", "invariants", "certora", "echidna",
    "testutil", "testutils", "test_helpers", "e2e_tests", "e2e", "integration_tests", "interchaintest", "test-clients",
    "dist", "bin", "obj", "coverage", "report", "reports", ".cache", ".next", ".nuxt", ".svelte-kit", ".turbo", ".vite",
    ".parcel-cache", ".pytest_cache", ".ruff_cache", ".mypy_cache", ".tox", ".nox", ".gradle", ".mvn",
    "vendor", ".cargo", "gitmodules", ".venv", "venv", "env", ".yarn", ".npm", ".pnpm", ".pnpm-store", "bower_components", "jspm_packages",
    "api", "third_party", "generated", "bindings", "gobindings", "gen", "codegen", "func++", "typechain", "typechain-types", "generated-types", "generated-sources",
)
NOISE_TOKENS = (
    "test", "tests", "mock", "mocks", "fixture", "fixtures", "example", "examples", "demo", "demos", "sample", "samples", "benchmark", "benchmarks", "bench",
    "benches", "fuzz", "fuzzing", "fuzzer", "poc", "pocs", "e2e", "integration", "invariant", "invariants", "certora", "echidna",
)
TEST_TOKENS = ("test", "tests", "tester", "testing", "mock", "mocks", "fixture", "fixtures", "fuzz", "fuzzer", "fuzzing", "example", "examples", "demo", "poc")
TEST_PARTS = ("testcmd", "testgen", "testperf", "testsuite", "testonly", "testlog", "testrand", "teststaking", "testslashing")
RESEARCH = {
    "scripts": "script", "script": "script", "deploy": "script", "deploys": "script", "deployment": "script", "deployments": "script", "broadcast": "script",
    "pocs": "poc", "poc": "poc", "fuzzing": "fuzz", "fuzzer": "fuzz", "fuzz": "fuzz", "invariants": "invariant", "invariant": "invariant", "certora": "certora", "echidna": "echidna",
}
SCRIPTS = (".ts", ".tsx", ".js", ".jsx", ".py")
DEPLOYMENT = ("deploy", "deploys", "deployment", "deployments")
LANGUAGES = {
    ".sol": "solidity", ".go": "go", ".rs": "rust", ".c": "cpp", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".java": "java", ".move": "move", ".clar": "clarity",
    ".vy": "vyper", ".cairo": "cairo", ".sw": "sway", ".fc": "ton", ".func": "ton", ".tact": "ton", ".tolk": "ton", ".proto": "proto", ".x": "xdr",
    ".ts": "typescript", ".tsx": "typescript", ".js": "typescript", ".jsx": "typescript", ".py": "python",
}
PROTOCOL_ROOTS = ("src", "source", "sources", "contracts", "contract", "programs", "program", "pallets", "pallet", "crates", "crate", "modules", "module", "packages", "package", "cmd", "internal", "pkg")
LOW_ROOTS = ("devtools", "tasks", "ops", "tools", "cli", "config", "configs", "deployment", "deployments", "deploy", "deploys")
PRIORITY = ("solidity", "move", "clarity", "vyper", "anchor", "substrate", "soroban", "rust", "go", "cpp", "java", "ton", "cairo", "sway", "typescript", "python", "proto", "xdr")
TEST_SUFFIXES = ("_test.go", "_test.rs", "_tests.rs", "_test.py", "_tests.py", "test.java", "tests.java", "it.java", "e2e.java")
TEST_STEMS = ("test", "tests", "tester", "testutils", "mock", "mocks", "fixture", "fixtures")
TEST_INFIXES = (".test.", ".spec.", ".e2e.", ".integration.", ".fixture.", ".fixtures.", ".mock.", ".mocks.")
GENERATED_INFIXES = (".pb.", ".pbjson.", ".pbgrpc.", ".grpc.", ".g.", ".gen.", ".generated.", ".abigen.", ".abi.", ".bind.", ".bindings.")
GENERATED_SUFFIXES = (
    ".pb.go", ".pb.gw.go", ".pulsar.go", ".gen.go", "_generated.go", ".generated.go", ".abigen.go", ".bind.go", ".pb.cc", ".pb.h", ".grpc.pb.cc", ".grpc.pb.h",
    "_pb2.py", "_pb2_grpc.py", "_pb.js", "_pb.ts", "_grpc_pb.js", "_grpc_pb.ts",
)
LIBRARY_FILES = ("stdlib.fc", "stdlib.func", "classlib.fc", "classlib.func", "testutils.fc")
KEPT_CONFIGS = ("hardhat.config.js", "hardhat.config.ts", "truffle-config.js")


def _ends(x: Column, suffixes) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | x.endswith(s)
    return out


def _holds(x: Column, parts) -> Column:
    out = F.lit(False)
    for s in parts:
        out = out | F.contains(x, F.lit(s))
    return out


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The last dot of the file name and what follows, in lower case; empty where there is none or only a leading or closing one."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def skipped_dir(name: Column, include_research: bool = False) -> Column:
    """Whether a directory has little to tell."""
    low = F.lower(name)
    tokens = F.split(F.translate(low, "-.", "__"), "_")
    noise = F.arrays_overlap(tokens, _array(NOISE_TOKENS))
    spared = F.arrays_overlap(tokens, _array(RESEARCH)) if include_research else F.lit(False)
    named = low.startswith("test") | low.startswith("mock") | _ends(low, ("test", "tests", "testing", "mock", "mocks", "fixture", "fixtures"))
    return F.when(low.isin(*RESEARCH), F.lit(not include_research)).when(low.isin(*IGNORED_DIRS) | low.endswith(".egg-info"), True).when(noise, ~spared).otherwise(named)


def _script_name(path: Column) -> Column:
    tokens = F.arrays_overlap(name_tokens(stem(path)), _array(DEPLOYMENT))
    return ((suffix(path) == ".sol") & F.lower(path).endswith(".s.sol")) | (suffix(path).isin(*SCRIPTS) & tokens)


def source_context(path: ColumnLike) -> Column:
    """production, or what kind of research file it is: by its directories, the first that tells, else by its name."""
    low = F.translate(F.lower(_c(path)), "\\", "/")
    parts = F.filter(F.split(low, "/"), lambda x: x != "")
    dirs = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.isin(*RESEARCH))
    alias = F.create_map(*(F.lit(x) for pair in RESEARCH.items() for x in pair))
    return F.when(F.size(dirs) > 0, F.element_at(alias, F.get(dirs, F.lit(0)))).when(_script_name(low), "script").otherwise("production")


def noise(path: ColumnLike, include_research: bool = False) -> Column:
    """Why a file is not indexed; empty if it is."""
    path = _c(path)
    name, ext, base = F.lower(file_name(path)), suffix(path), F.lower(stem(path))
    parts = F.split(F.lower(path), "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    skipped = F.get(F.filter(dirs, lambda d: (d != "") & skipped_dir(d, include_research)), F.lit(0))
    web = ext.isin(".ts", ".tsx", ".js", ".jsx")
    test = (
        name.startswith("test_") | name.startswith("mock_") | _ends(name, TEST_SUFFIXES) | base.startswith("test") | base.startswith("mock")
        | F.arrays_overlap(name_tokens(stem(path)), _array(TEST_TOKENS)) | _ends(base, TEST_STEMS) | _holds(base, TEST_PARTS) | _holds(base, ("testnet",)) | _holds(name, TEST_INFIXES)
    )
    solidity_test = (ext == ".sol") & (name.startswith("test") | name.startswith("mock") | _ends(name, ("test.sol", "tests.sol", "mock.sol", "mocks.sol")))
    generated = (
        _ends(name, GENERATED_SUFFIXES) | _holds(name, GENERATED_INFIXES) | ((ext == ".java") & _ends(name, ("proto.java", "grpc.java", "grpcservice.java")))
        | (web & _ends(name, (".d.ts", ".min.js", ".bundle.js", ".umd.js")))
    )
    docs = (F.array_contains(parts, "docs") & F.array_contains(parts, "static")) | F.array_contains(parts, "storybook")
    config = _ends(name, (".config.js", ".config.ts", ".config.mjs", ".config.cjs")) & ~name.isin(*KEPT_CONFIGS)
    out = F.when(~ext.isin(*LANGUAGES), "unsupported_extension").when(skipped.isNotNull(), F.concat(F.lit("ignored_dir:"), skipped))
    if not include_research:
        out = out.when((ext == ".sol") & name.endswith(".s.sol"), "foundry_test_or_script").when(_script_name(path), "research_file:script")
    out = out.when(test, "test_file").when((ext == ".sol") & name.endswith(".t.sol"), "foundry_test_or_script").when(solidity_test, "test_file")
    out = out.when((ext == ".py") & name.isin("conftest.py", "noxfile.py"), "test_file").when(generated, "generated_file")
    out = out.when(ext.isin(".fc", ".func", ".tact", ".tolk") & name.isin(*LIBRARY_FILES), "library_file")
    return out.when(web & docs, "docs_frontend").when(web & config, "tool_config").otherwise("")


def language(path: ColumnLike, content: Column | None = None) -> Column:
    """By extension; Rust files by what they use, if the content is there."""
    ext = suffix(_c(path))
    out = F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), ext)
    if content is not None:
        has = lambda s: F.contains(content, F.lit(s))
        rust = F.when(has("use anchor_lang") | has("#[program]"), "anchor").when(has("#[pallet::call]") | has("#[frame_support::pallet]"), "substrate")
        rust = rust.when(has("use soroban_sdk") | (has("#[contract]") & has("#[contractimpl]")), "soroban").otherwise("rust")
        out = F.when(ext == ".rs", rust).otherwise(out)
    return F.coalesce(out, F.lit("generic"))


def extractors(lang: Column) -> Column:
    """The extractors that read a file: the generic one too for Rust dialects."""
    return F.when(lang.isin("anchor", "substrate", "soroban"), F.array(lang, F.lit("rust"))).otherwise(F.array(lang))


def priority(path: ColumnLike, lang: Column, detected: str = "") -> Column:
    """What to read first: a struct to order by. The root is the first part of the path; the repository's own language comes before others."""
    path = _c(path)
    parts = F.filter(F.split(F.lower(path), "/"), lambda x: x != "")
    first = F.get(parts, F.lit(0))
    root = F.when(first.isin(*PROTOCOL_ROOTS), 0).when(first.isin(*LOW_ROOTS), 2).otherwise(1)
    rank = F.array_position(_array(PRIORITY), lang)
    language = F.when(lang == F.lit(detected), -1).when(rank > 0, rank).otherwise(99)
    context = F.when(source_context(path) == "production", 0).otherwise(3)
    return F.struct(context.alias("context"), root.alias("root"), language.alias("language"), F.size(parts).alias("depth"), F.lower(path).alias("path"))


def numbered(files: DataFrame, detected: str = "") -> DataFrame:
    """(path, number): files from 0 in the order of priority, by a sort over all tasks; no content is moved."""
    ordered = files.select("path", priority("path", F.col("language"), detected).alias("p")).orderBy("p", "path").select("path", F.monotonically_increasing_id().alias("at"))
    ordered = cut(ordered.withColumn("part", F.shiftright("at", 33)))
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each task
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    starts = F.broadcast(files.sparkSession.createDataFrame(starts, "part long, start long"))
    return ordered.join(starts, "part").select("path", (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("number"))


#: Dependencies in a Cargo.toml that make all Rust files of a tree one dialect, the first that is found.
CARGO = (("anchor-lang", "anchor"), ("frame-support", "substrate"), ("sp-runtime", "substrate"), ("soroban-sdk", "soroban"))


def cargo_dialect(spark: SparkSession, root: str) -> str:
    """The Rust dialect that the tree's Cargo.toml asks for, or else that of its first directory that has one; empty if neither does."""
    found = _files(spark, root, "Cargo.toml").where(F.size(F.split("path", "/")) <= 2)
    first = found.orderBy(F.size(F.split("path", "/")), "path").select("content").first()
    return next((dialect for word, dialect in CARGO if first and word in (first[0] or "")), "")


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(base)
    local = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/{0,2}(?=/)", "")
    path = F.regexp_replace(local, "^.*?" + "".join(f"\\{c}" if not c.isalnum() and c != "/" else c for c in base.split(":")[-1].replace("//", "/")) + "/", "")
    return raw.select(path.alias("path"), F.col("content").cast("string").alias("content"))


def read_tree(spark: SparkSession, root: str, include_research: bool = False) -> DataFrame:
    """(path, content, language, source_context, reason): the files below root in a supported language, with the reason why one is not indexed; others are not read."""
    endings = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext) for ext in LANGUAGES)
    rows, dialect = _files(spark, root, "*{" + endings + "}"), cargo_dialect(spark, root)
    lang = language("path", F.col("content"))
    lang = F.when(suffix(F.col("path")) == ".rs", F.lit(dialect)).otherwise(lang) if dialect else lang
    return rows.select("path", "content", lang.alias("language"), source_context("path").alias("source_context"), noise("path", include_research).alias("reason"))
