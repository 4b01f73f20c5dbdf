"""Gaps of verification, read from sources: functions without a direct test, stubs, boundaries without a test of their failure.

Everything comes from the syntax nodes of a project's files, src/ and tests/: which public functions stand at the top
of a module, what tests import and then name, under which other modules a function is given out, what a function
calls (names resolved by scope), and which of those calls leave the process.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.operators.patterns import MOST, occurring
from siftspark.operators.scopes import FUNCTIONS, absolute, imports, module_of, regions, resolved
from siftspark.operators.structure import enclosing
from siftspark.session import stored_wide

#: Calls that leave the process, by full name, by last name, and those of databases; fixed values.
BOUNDARIES = (
    "requests.request requests.get requests.post requests.put requests.patch requests.delete requests.head requests.Session "
    "httpx.request httpx.get httpx.post httpx.put httpx.delete httpx.stream httpx.Client httpx.AsyncClient "
    "urllib.request.urlopen urllib.request.Request aiohttp.ClientSession aiohttp.request websockets.connect websocket.create_connection "
    "subprocess.run subprocess.Popen subprocess.call subprocess.check_call subprocess.check_output os.system os.popen os.execv os.execvp os.spawnv "
    "socket.socket socket.create_connection socket.getaddrinfo "
    "sqlite3.connect psycopg.connect psycopg2.connect asyncpg.connect pymysql.connect mysql.connector.connect MySQLdb.connect sqlalchemy.create_engine "
    "redis.Redis redis.from_url boto3.client boto3.resource botocore.client pymongo.MongoClient elasticsearch.Elasticsearch "
    "kafka.KafkaProducer kafka.KafkaConsumer pika.BlockingConnection"
).split()
BOUNDARY_LEAVES = "urlopen create_connection getaddrinfo Popen check_output check_call create_engine MongoClient".split()
DB_LEAVES = ["execute", "executemany"]
#: What in a test's text shows that it tests a failure, and parts of names of such tests; fixed values.
FAILURE_MARKERS = (
    "pytest.raises", "raises(", "side_effect", "raise_for_status", "TimeoutError", "TimeoutExpired", "socket.timeout", "ReadTimeout", "ConnectTimeout",
    "ConnectionError", "ConnectionResetError", "ConnectionRefusedError", "BrokenPipeError", "CalledProcessError", "HTTPError", "RequestException",
    "ClientError", "JSONDecodeError", "UnicodeDecodeError", "OperationalError", "IntegrityError", "PermissionError", "FileNotFoundError",
    "NotADirectoryError", "OSError", "IOError", "CancelledError", "KeyboardInterrupt",
)
FAILURE_NAMES = (
    "fail error timeout retr unavailable refus reject broken interrupt cancel degrade fallback raise denied exhaust partial missing without absent none "
    "empty invalid malformed incomplete unsupported unset disabled stale conflict corrupt"
).split()
#: Beginnings of names of calls that leave the process, and what in a test's text shows that it makes something fail; fixed values.
BOUNDARY_PREFIXES = (
    "open pathlib.Path.open pathlib.Path.read_text pathlib.Path.read_bytes pathlib.Path.write_text pathlib.Path.write_bytes requests. httpx. "
    "aiohttp. urllib.request. socket. subprocess. os.system os.remove os.unlink os.replace os.rename os.mkdir os.makedirs shutil. sqlite3.connect boto3."
).split()
FAULT_MARKERS = (
    "monkeypatch", "patch(", "patch.object", "side_effect", "pytest.raises", "raises(", "oserror", "ioerror", "timeouterror", "timeout",
    "connectionerror", "connection_error", "permissionerror", "filenotfounderror",
)
#: Decorators under which an empty body is a contract; fixed values.
CONTRACTS = "abstractmethod overload abstractproperty".split()


def functions(nodes: DataFrame) -> DataFrame:
    """Public functions at the top of the modules in src/: path, lo, line, name, module, symbol."""
    top = nodes.where(F.col("kind").isin(*FUNCTIONS) & (F.col("parent") == 0) & (F.col("col") == 0) & F.col("path").like("src/%") & ~F.col("name").rlike("^(_|test)"))
    return top.select("path", "lo", "line", "name", module_of(F.col("path")).alias("module"), F.concat_ws("::", "path", "name").alias("symbol"))


def chains(nodes: DataFrame) -> DataFrame:
    """path, lo, root (the name's node), parts: attribute chains that start at a name, with nothing else in them, and names alone."""
    parts = F.split("name", "[.]")
    pure = nodes.where(F.col("kind").isin("Name", "Attribute") & (F.col("hi") - F.col("lo") == F.size(parts) - 1))
    return pure.select("path", "lo", "func", "cls", F.col("hi").alias("root"), parts.alias("parts"))


def mentions(nodes: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """module, name: what test files import and then name, or reach through a module that they import; of all their nodes, or of those `within` (path, lo)."""
    tests = nodes.where(F.col("path").like("tests/%"))
    known = imports(tests)
    here = tests.where(F.col("kind").isin("Name", "Attribute"))
    here = here if within is None else here.join(within, ["path", "lo"], "left_semi")
    named = here.select("path", F.element_at(F.split("name", "[.]"), -1).alias("name")).distinct()
    direct = known.where("module IS NOT NULL").select("path", "module", "name").join(named, ["path", "name"], "left_semi").select("module", "name")
    # a file's import of a name, wherever it stands; the last one counts
    local = known.where("dots IS NULL").groupBy("path", "name").agg(F.max_by("origin", "bfs").alias("base"))
    long = chains(here).where(F.size("parts") > 1).select("path", F.get("parts", F.lit(0)).alias("name"), "parts").join(local, ["path", "name"])
    inner = F.slice("parts", F.lit(2), F.size("parts") - 2)
    through = long.select(F.concat_ws(".", F.col("base"), inner).alias("module"), F.element_at("parts", -1).alias("name"))
    return direct.unionByName(through).distinct()


def names_of(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """symbol, module, name: every module that gives a symbol out, its own and those of src/ that import it."""
    given = imports(nodes.where(F.col("path").like("src/%"))).withColumn("source", absolute(F.col("module"), F.col("dots"), F.col("path"))).where("source IS NOT NULL")
    given = given.select(F.col("source").alias("module"), F.col("symbol").alias("name"), module_of(F.col("path")).alias("other")).distinct()
    own = symbols.select("symbol", "module", "name")
    return own.unionByName(own.join(given, ["module", "name"]).select("symbol", F.col("other").alias("module"), "name")).distinct()


def _text(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """nodes with `text`: their lines of the source."""
    lines = F.slice(F.split("source", "\n"), F.col("line"), F.col("end_line") - F.col("line") + 1)
    return nodes.join(sources.select("path", "source"), "path").withColumn("text", F.array_join(lines, "\n")).drop("source")


def failure_places(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, lo: nodes in test functions whose name or text shows that they test a failure."""
    tests = nodes.where(F.col("kind").isin(*FUNCTIONS) & F.col("path").like("tests/%")).select("path", "lo", "hi", "line", "end_line", "name")
    shows = F.col("name").rlike("|".join(FAILURE_NAMES))
    for marker in FAILURE_MARKERS:
        shows = shows | F.contains("text", F.lit(marker))
    failing = _text(tests, sources).where(shows).select("path", F.col("lo").alias("start"), F.col("hi").alias("stop"))
    places = nodes.where(F.col("path").like("tests/%") & F.col("kind").isin("Name", "Attribute")).select("path", F.col("lo").alias("place"))
    return enclosing(places, failing, nearest=True).select("path", F.col("place").alias("lo")).distinct()


def calls(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, lo (of the function), called: dotted names that a function's own body calls, roots resolved by scope; callee: the node, if it is a function of the same file."""
    body = regions(nodes).select("path", F.col("scope").alias("func"), "start", "stop")
    own = symbols.select("path", F.col("lo").alias("func"))
    made = nodes.where("kind = 'Call'").join(own, ["path", "func"]).join(body, ["path", "func"]).where("lo BETWEEN start AND stop AND cls < func").select("path", "func", F.col("lo").alias("parent"))
    callees = nodes.where("field = 'func'").select("path", "parent", "lo")
    named = made.join(callees, ["path", "parent"]).join(chains(nodes).select("path", "lo", "root", "parts"), ["path", "lo"])
    found = resolved(nodes).select("path", F.col("lo").alias("root"), "definition", "how", "origin")
    rest = F.slice("parts", F.lit(2), F.size("parts"))
    out = named.join(found, ["path", "root"], "left")
    called = F.concat_ws(".", F.coalesce("origin", F.get("parts", F.lit(0))), rest)
    callee = F.when((F.col("how") == "function") & (F.size("parts") == 1), F.col("definition"))
    return out.select("path", F.col("func").alias("lo"), called.alias("called"), callee.alias("callee")).distinct()


def stubs(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, lo of functions whose body does nothing: pass, an ellipsis or text alone, a NotImplementedError, a constant returned."""
    children = nodes.select("path", F.col("parent").alias("lo"), "field", "kind", F.col("name").alias("said"), F.col("lo").alias("child"), F.col("hi").alias("until"))
    below = symbols.select("path", "lo").join(children, ["path", "lo"])
    contract = below.where(F.col("field").eqNullSafe("decorator_list") & F.col("kind").isin("Name", "Attribute") & F.element_at(F.split("said", "[.]"), -1).isin(*CONTRACTS)).select("path", "lo")
    body = below.where("field = 'body'").groupBy("path", "lo").agg(F.count_if(F.col("kind") != "Expr").alias("does"), F.max(F.when(F.col("kind") != "Expr", F.struct("kind", "child"))).alias("only"))
    one = body.select("path", "lo", "does", "only.kind", F.col("only.child").alias("parent"))
    inside = nodes.where("field IN ('exc', 'value')").select("path", "parent", F.col("kind").alias("held"), F.col("name").alias("raised"))
    found = one.join(inside, ["path", "parent"], "left")
    raises = (F.col("kind") == "Raise") & (F.when(F.col("held") == "Name", F.col("raised")).when(F.col("held") == "Call", F.element_at(F.split("raised", "[.]"), -1)) == "NotImplementedError")
    nothing = (F.col("does") == 0) | ((F.col("does") == 1) & ((F.col("kind") == "Pass") | raises | ((F.col("kind") == "Return") & (F.col("held") == "Constant"))))
    return found.where(nothing).select("path", "lo").distinct().join(contract, ["path", "lo"], "left_anti")


def gaps(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """sources: path, source, and their nodes (read several times: store them first). code, path, line, severity, message of BHVERIFY001, BHIMPL001 and BHVERIFY002; a function has one of them at most."""
    symbols = stored_wide(functions(nodes), "functions")
    keys = stored_wide(names_of(symbols, nodes), "symbol-names")
    tested = stored_wide(keys.join(mentions(nodes), ["module", "name"], "left_semi").select("symbol").distinct(), "tested")
    failing = mentions(nodes, failure_places(sources, nodes))
    failure = keys.join(failing, ["module", "name"], "left_semi").select("symbol").distinct()
    made = stored_wide(calls(symbols, nodes), "calls")
    own = symbols.select("path", "lo", "symbol")
    near = made.where("callee IS NOT NULL").join(symbols.select("path", F.col("lo").alias("callee"), F.col("symbol").alias("target")), ["path", "callee"]).select("path", "lo", "target")
    far = made.join(keys.select(F.concat_ws(".", "module", "name").alias("called"), F.col("symbol").alias("target")), "called").where("callee IS NULL").select("path", "lo", "target")
    reached = near.unionByName(far).join(tested.withColumnRenamed("symbol", "target"), "target", "left_semi").join(own, ["path", "lo"])
    callees = reached.groupBy("symbol").agg(F.sort_array(F.collect_set(F.split_part("target", F.lit("::"), F.lit(2)))).alias("callees"))
    leaf = F.element_at(F.split("called", "[.]"), -1)
    leaving = made.where(F.col("called").isin(*BOUNDARIES) | leaf.isin(*BOUNDARY_LEAVES, *DB_LEAVES)).join(own, ["path", "lo"])
    leaving = leaving.groupBy("symbol").agg(F.sort_array(F.collect_set("called")).alias("boundaries"))
    hollow = stubs(symbols, nodes).withColumn("stub", F.lit(True))
    all_ = symbols.join(tested.withColumn("direct", F.lit(True)), "symbol", "left").join(failure.withColumn("failing", F.lit(True)), "symbol", "left")
    all_ = all_.join(callees, "symbol", "left").join(leaving, "symbol", "left").join(hollow, ["path", "lo"], "left")
    code = (
        F.when(F.col("direct").isNull() & F.col("callees").isNotNull(), "BHVERIFY001")
        .when(F.col("direct").isNull() & F.col("stub").isNotNull(), "BHIMPL001")
        .when(F.col("failing").isNull() & F.col("boundaries").isNotNull(), "BHVERIFY002")
    )
    first = lambda names, n: F.array_join(F.slice(names, 1, n), ", ")
    message = (
        F.when(F.col("code") == "BHVERIFY001", F.concat("name", F.lit(" is tested through others only: "), first("callees", 5)))
        .when(F.col("code") == "BHIMPL001", F.concat("name", F.lit(" is a public stub without a test")))
        .otherwise(F.concat("name", F.lit(" leaves the process without a test of failure: "), first("boundaries", 4)))
    )
    return all_.withColumn("code", code).where("code IS NOT NULL").select("code", "path", "line", F.lit("warning").alias("severity"), message.alias("message"))


def fault_boundaries(sources: DataFrame, nodes: DataFrame, most: int = MOST) -> DataFrame:
    """path, line, function, boundary: calls over a boundary in a function at the top of a module in src/ whose name no test that makes something fail contains, in any case."""
    top = nodes.where(F.col("kind").isin(*FUNCTIONS) & (F.col("parent") == 0) & F.col("path").like("src/%"))
    top = top.select("path", F.col("lo").alias("start"), F.col("hi").alias("stop"), "name", F.concat_ws(".", module_of(F.col("path")), "name").alias("function"))
    made = nodes.where("kind = 'Call'").select("path", F.col("lo").alias("parent"), "line")
    # of a.b().c the name is c alone
    pure = F.col("hi") - F.col("lo") == F.size(F.split("name", "[.]")) - 1
    callee = nodes.where("field = 'func' AND kind IN ('Name', 'Attribute')").select("path", "parent", "lo", F.when(pure, F.col("name")).otherwise(F.element_at(F.split("name", "[.]"), -1)).alias("boundary"))
    beyond = F.lit(False)
    for prefix in BOUNDARY_PREFIXES:
        beyond = beyond | F.startswith(F.lower("boundary"), F.lit(prefix.lower()))
    leaving = made.join(callee, ["path", "parent"]).where(beyond)
    held = enclosing(leaving.select("path", F.col("parent").alias("place")), top, nearest=True).withColumnRenamed("place", "parent")
    rows = stored_wide(leaving.join(held, ["path", "parent"]).select("path", "line", "function", "boundary", F.lower("name").alias("name")), "boundaries")
    tests = nodes.where(F.col("kind").isin(*FUNCTIONS) & F.col("path").rlike("^tests?/") & F.col("name").like("test%"))
    fails = F.lit(False)
    for marker in FAULT_MARKERS:
        fails = fails | F.contains("text", F.lit(marker))
    bodies = _text(tests, sources).select(F.lower("text").alias("text")).where(fails)
    return rows.join(occurring(rows.select("name"), bodies, most), "name", "left_anti").select("path", "line", "function", "boundary")
