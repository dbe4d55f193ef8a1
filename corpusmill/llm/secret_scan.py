"""Secret scans: a high-recall pattern finds candidates, a random forest removes the false positives.

All of it is DataFrame and SQL work. A candidate's features are its length, how often its characters change kind,
how much of it dictionary words cover, its alphabet, the path of its document and the words beside it. The forest
is trained by Spark ML on labelled findings and becomes a SQL expression, so that scoring is a projection: no row
is exploded, joined or shuffled.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BEFORE, AFTER = 40, 12  #: characters of context
TREES, DEPTH, SEED = 25, 6, 7
THRESHOLD = 0.5

#: Words that make up identifiers, paths and prose.
DICTIONARY = (
    "the and for with from that this have not are was you all can out use get set add new old key value name user file path data test type code line text word page list item index count size time date year month "
    "order number version build release update config default main master server client host local remote public string object class function method return result error message request response handler service "
    "module package library python java script http https www com org net usr lib bin etc var home opt dist src docs image style account report invoice product customer session table column query schema"
).split()
#: Words before a value that speak for a secret, and against one.
FOR_WORDS = "token|secret|passw(?:or)?d|passwd|pwd|api[ _-]?key|apikey|access[ _-]?key|auth(?:orization)?|bearer|credentials?|private[ _-]?key|signing[ _-]?key|client[ _-]?secret|webhook"
AGAINST_WORDS = "commit|revision|rev|sha-?[0-9]*|md5|checksum|digest|hash|etag|uuid|guid|id|isbn|order|invoice|version|serial|build|phone|card|base64|integrity|fingerprint|page|session"

#: What stands after such a word in code and prose without being a secret.
USUAL_VALUES = "required|optional|undefined|disabled|enabled|missing|invalid|expired|incorrect|forbidden|unauthorized|protected|encrypted|password|passphrase|credentials?|authenticated|authentication|authorization|something|anything|nothing|whatever|accepted|rejected|forgotten|unchanged|generated|automatic|basic|bearer|null|none|true|false"

_HEADER = "-----BEGIN [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
_END = "-----END [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
#: Private keys to their END line; without one, to the last line that looks like the key's.
_BLOCK = rf"{_HEADER}(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+){{0,64}}+{_END}|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{{40,}}+){{0,400}}+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{{4,}}+={{1,2}}+)?)"
#: 8 or more characters that are no spaces, given to a word that speaks for a secret; quoted, up to the quote. Cheap looks go first.
_ASSIGNED = (
    r"(?<=[\s\"'=:>])(?=\S{8})(?<=(?:[:=>]|(?i:bearer|basic))[ \t]{0,3}[\"']?)"
    rf"(?<=(?i:{FOR_WORDS})[\"']?[ \t]{{0,3}}(?::=|=>|[:=])[ \t]{{0,3}}(?:(?i:bearer|basic)[ \t]{{1,3}})?[\"']?)"
    r"(?:(?<=\")[^\s\"]{8,}+|(?<=')[^\s']{8,}+|(?<![\"'])(?![=>\"']|(?i:bearer|basic)[ \t])\S{7,}[^\s,;)}\]\"'<>])"
)
#: Three runs of web-safe base 64 with full stops between, the first of which spells the start of a JSON object.
_SIGNED = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
#: Private keys, values of words that speak for a secret, signed tokens, and runs of 16 or more characters of usual keys with a digit or a known start.
#: A run does not begin with the name of a word that speaks for a secret and an equals sign: its value is the candidate.
_RUN = rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9]|AKIA|ASIA|gh[pousr]_|glpat-|xox[abp]-|sk_live_|AIza)(?![A-Za-z0-9_-]{{0,40}}?(?i:{FOR_WORDS})=)[A-Za-z0-9+/_=-]{{16,}}+"
PATTERN = rf"{_BLOCK}|{_ASSIGNED}|{_SIGNED}|{_RUN}"


def features(c: str, b: str, a: str, p: str) -> dict[str, str]:
    """SQL of each feature; c: candidate, b and a: text before and after it, p: path of its document."""
    size = f"greatest(length({c}), 1)"
    share = lambda kept: f"length(regexp_replace({c}, '[^{kept}]', '')) / {size}"
    flag = lambda x: f"cast({x} as double)"
    words = "|".join(sorted([*DICTIONARY, *USUAL_VALUES.replace("s?", "s").split("|")], key=lambda w: (-len(w), w)))
    return {
        "len": f"cast(length({c}) as double)",
        "transitions": f"regexp_count({c}, '(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[^A-Za-z0-9])') / {size}",
        "digits": share("0-9"),
        "upper": share("A-Z"),
        "marks": share("+/_=-"),
        "distinct": f"size(array_distinct(split({c}, ''))) / {size}",
        "hex": flag(f"{c} rlike '^[0-9a-fA-F]+$'"),
        "dictionary": f"1 - length(regexp_replace(lower({c}), '{words}', '')) / {size}",
        "prefixed": flag(f"{c} rlike '(?:^|[^A-Za-z0-9])(?:AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abp]-|sk_live_|sk-|AIza|eyJ[A-Za-z0-9_-]+[.]eyJ|-----BEGIN )'"),
        "key_body": flag(f"{c} rlike '^-----BEGIN ' and {c} rlike '[A-Za-z0-9+/=]{{40}}'"),
        "filler": flag(f"lower({c}) rlike 'example|your|xxxx|placeholder|changeme|change_me|dummy|sample|1234567|abcdef0123|^(?:{USUAL_VALUES})[^a-z0-9]*$' or {c} rlike '^(?:[$<{{%*]|[A-Za-z_]+[(.][A-Za-z_]+[(.]|[A-Za-z_.]+[(])'"),
        "word_for": flag(f"lower({b}) rlike '(?:{FOR_WORDS})[^a-z0-9]*$'"),
        "near_for": flag(f"lower({b}) rlike '(?:{FOR_WORDS})'"),
        "word_against": flag(f"lower({b}) rlike '(?<![a-z])(?:{AGAINST_WORDS})[^a-z0-9]*$'"),
        "assigned": flag(f"{b} rlike '[:=]\\\\s*[\"\\']?$'"),
        "quoted": flag(f"{b} rlike '[\"\\']$' and {a} rlike '^[\"\\']'"),
        "in_path": flag(f"{b} rlike '(?:://|[./])[^ ]*$' or {c} rlike '/[a-z]+.*/[a-z]'"),
        "test_path": flag(f"lower(coalesce({p}, '')) rlike 'test|example|sample|fixture|mock'"),
    }


def labelled(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """candidate, before, after, path, label: findings from a rule over a counter, secrets and look-alikes in equal parts."""
    h = lambda salt, n: f"substr(concat(sha2(concat('{salt}', id), 256), sha2(concat('{salt}+', id), 256)), 1, {n})"
    b62 = lambda salt, n: f"substr(translate(base64(unhex(concat(sha2(concat('{salt}', id), 256), sha2(concat('{salt}+', id), 256)))), '+/=', 'xQ7'), 1, {n})"
    pick = lambda salt, *xs: "element_at(array(" + ", ".join("'" + x.replace("'", "\\'") + "'" for x in xs) + f"), cast(pmod(xxhash64(concat('{salt}', id)), {len(xs)}) + 1 as int))"
    prose = pick("prose", "of the one that ", "er la que ", "und der ein ", "note that ", "ti on re ", "x ")
    says = pick("says", 'token = "', "token: ", "api_key = ", 'API_KEY="', "secret=", "password: ", "Authorization: Bearer ", "client_secret = '", "access_key=", "TOKEN = ")
    not_says = pick("not", "commit ", "sha256: ", "md5 = ", "checksum ", "revision ", 'etag: "', "integrity=", "digest: ", "hash ", "uuid ", "id=")
    plain = pick("plain", "see ", "the ", "of ", "in ", "and ", "")
    letters = lambda salt, n: f"substr(translate({h(salt, 64)}, '0123456789abcdef', 'qwertyuiopasdfgh'), 1, {n})"
    short = lambda salt: f"substr(concat({pick(salt, 'Hunter', 'tr0ub', 'S3', 'pa', 'Zq', 'winter')}, {pick(salt + '1', '!', '.', '@', '#', ':', '-', '&', '$')}, {b62(salt + '2', 12)}), 1, cast(8 + pmod(xxhash64(id), 8) as int))"
    named = pick("named", "password: ", 'password = "', "passwd=", "pwd: ", "PASSWORD='", "secret = ", 'api_key: "', "credentials: ", "token=")
    block = lambda line, last: f"concat('-----BEGIN ', {pick('kind', '', 'RSA ', 'EC ', 'OPENSSH ')}, 'PRIVATE KEY-----\\n', repeat(concat({line}, '\\n'), cast(1 + pmod(id, 29) as int)), {last})"
    path = pick("path", "src0", "src1", "src5", "config/app.yaml", "deploy/prod.env", "lib/server.py", "docs/notes.md", "")
    made_up = pick("made_up", "tests/fixtures/keys.json", "test/data/login.py", "examples/settings.env", "lib/mock_server.py", "samples/config.yaml")
    jwt = f"concat('eyJ', {b62('L', 30)}, '.eyJ', {b62('M', 40)}, '.', {b62('N', 43)})"
    secrets = [
        (h("a", 40), says), (h("b", 32), says), (f"upper({h('c', 40)})", says), (b62("d", 32), says), (b62("e", 44), says), (f"concat('AKIA', upper({b62('f', 16)}))", f"concat({plain}, {prose})"), (f"concat('ghp_', {b62('g', 36)})", plain),
        (b62("h", 24), says), (h("i", 64), says), (pick("key", "-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----"), plain),
        (short("E"), named), (letters("F", "cast(8 + pmod(xxhash64(id), 8) as int)"), named), (f"concat({letters('G', 5)}, {pick('mark', '.', '!', '@', '#', ':', '-')}, {letters('H', 6)}, {pick('mark2', '', '7', '99', '!')})", named), (block(b62("B", 64), "'Qw==\\n-----END PRIVATE KEY-----'"), plain), (block(h("C", 64), "'-----END PRIVATE KEY-----'"), plain), (f"trim(TRAILING '\\n' FROM {block(b62('D', 64), chr(39) * 2)})", plain), (f"concat({b62('I', 12)}, '.', {b62('J', 14)}, '.', {b62('K', 10)})", says), (jwt, plain),
    ]
    others = [
        (h("k", 40), not_says), (h("l", 64), not_says), (h("m", 32), not_says), (f"concat_ws('-', {h('n', 8)}, {h('o', 4)}, {h('p', 4)}, {h('q', 4)}, {h('r', 12)})", f"concat({not_says}, '')"), (f"translate({h('s', 16)}, 'abcdef', '012345')", plain), (f"translate({h('t', 19)}, 'abcdef', '987654')", pick("card", "card ", "order ", "phone ", "", "nr ")),
        (f"concat({pick('u', 'get_user_by_id_', 'invoice-report-', 'release_version_', 'default-config-file-', 'session_table_')}, pmod(id, 97), {pick('v', '_handler', '-build', '_v2', '')})", plain), (f"concat({pick('w', 'usr/lib/python', 'opt/service/build', 'home/user/docs/page')}, pmod(id, 9), '/', {pick('x', 'dist/packages/module', 'test/data/index')})", "'/'"),
        (pick("y", "YOUR_API_KEY_12345678", "xxxxxxxxxxxxxxxx1234", "EXAMPLE-KEY-0123456789", "changeme-1234567890abc", "your-token-here-1234"), says), (f"concat('20', pmod(id, 89) + 10, '-01-15T10-30-00_', pmod(id, 13))", plain), (b62("z", 40), pick("blob", "base64,", "integrity=", "fingerprint ", "etag=")),
        (pick("usual", *[w for w in USUAL_VALUES.replace("s?", "s").split("|") if len(w) >= 8]), named), (pick("code", "os.environ.get(", "process.env.TOKEN", "config.get_value()", "${DB_PASSWORD}", "<password>", "self.settings.key", "getpass.getpass()", "{{ secret }}", "********", "get_password()", "%(password)s"), named),
        (pick("filled", "changeme", "your-password", "example123", "dummy-value", "placeholder", "xxxxxxxx", "your_token", "sample-key"), named), ("concat('-----BEGIN PRIVATE KEY-----\\n', " + pick("empty", "YOUR_KEY_HERE", "EXAMPLE", "your private key", "placeholder") + ", '\\n-----END PRIVATE KEY-----')", plain),
    ]
    which = lambda xs: "CASE pmod(cast(id / 2 as long), {}) {} END".format(len(xs), " ".join(f"WHEN {k} THEN named_struct('c', {c}, 'b', {b})" for k, (c, b) in enumerate(xs)))
    # the same values in paths of tests and examples are made up
    secrets += [(block(b62("O", 64), "'Qw==\\n-----END PRIVATE KEY-----'"), plain, made_up), (f"concat('ghp_', {b62('P', 36)})", plain, made_up)]  # but not these
    others += [(value, says, made_up) for value in (b62("t", 32), h("u", 40), b62("v", 44))] + [(short("w"), named, made_up), (f"concat('AKIA', upper({b62('x', 16)}))", plain, made_up)]
    which = lambda xs: "CASE pmod(cast(id / 2 as long), {}) {} END".format(len(xs), " ".join(f"WHEN {k} THEN named_struct('c', {c}, 'b', {b}, 'p', {p[0] if p else path})" for k, (c, b, *p) in enumerate(xs)))
    base = spark.range(0, rows, 1, 2).selectExpr("id", f"CASE WHEN id % 2 = 1 THEN {which(secrets)} ELSE {which(others)} END AS x")
    return base.selectExpr("x.c AS candidate", f"concat({prose}, x.b) AS before", "CASE WHEN x.b rlike '\"$' THEN '\" and' WHEN x.b rlike '\\'$' THEN '\\' on' ELSE ' the' END AS after", "x.p AS path", "cast(id % 2 as double) AS label")


def forest_sql(findings: DataFrame, x: str, trees: int = TREES, depth: int = DEPTH) -> str:
    """Train on labelled findings; the share of trees that call a candidate a secret, as SQL over the fields of x."""
    names = list(features("candidate", "before", "after", "path"))
    frame = findings.selectExpr("label", *(f"cast({sql} as double) AS {name}" for name, sql in features("candidate", "before", "after", "path").items()))
    frame = VectorAssembler(inputCols=names, outputCol="features").transform(frame)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="onethird").fit(frame)

    def node(n) -> str:
        if n.getClass().getSimpleName() == "LeafNode":
            return f"{n.prediction():.1f}D"
        s = n.split()
        return f"CASE WHEN {x}.{names[s.featureIndex()]} <= {s.threshold()!r}D THEN {node(n.leftChild())} ELSE {node(n.rightChild())} END"

    return f"({' + '.join(node(t._call_java('rootNode')) for t in model.trees)}) / {trees}.0D"


_MADE: dict[tuple, str] = {}  #: the forest of the made findings, once an application: rule and seed are fixed, and training it costs the driver memory


def forest_of(spark: SparkSession, findings_labelled: DataFrame | None) -> str:
    if findings_labelled is not None:
        return forest_sql(findings_labelled, "x")
    key = (spark.sparkContext.applicationId, TREES, DEPTH, SEED)
    if key not in _MADE:
        _MADE[key] = forest_sql(labelled(spark), "x")
    return _MADE[key]


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


STEP = 256  #: places that are summed up together


def places(found: str, cut: str) -> str:
    """SQL of the places (from 1) of matches in their text; cut: what stands before each of them. Sums go in steps, so that many matches cost little."""
    size = f"(length(element_at({cut}, i)) + length(element_at({found}, i)))"
    add = lambda items, more: f"aggregate({items}, named_struct('at', 0L, 'out', cast(array() as array<bigint>)), (s, i) -> named_struct('at', s.at + {more}, 'out', array_append(s.out, s.at)))"
    groups = f"transform(filter(sequence(0, cast(size({found}) div {STEP} as int)), g -> g * {STEP} < size({found})), g -> {add(f'sequence(g * {STEP} + 1, least(g * {STEP} + {STEP}, size({found})))', size)})"
    return f"""element_at(transform(array({groups}), groups -> transform(flatten(zip_with(groups, {add("groups", "i.at")}.out, (g, before) -> transform(g.out, x -> x + before))),
        (x, k) -> x + length(element_at({cut}, k + 1)) + 1)), 1)"""


def findings(text: str, path: str, forest: str) -> str:
    """SQL of one text's array<struct<nth, candidate, before, after, start, score>>, as field found of a struct whose field
    cut has the text between candidates; text and path are SQL."""
    cut = f"split({text}, {quoted(PATTERN)}, -1)"
    made = f"regexp_extract_all({text}, {quoted(PATTERN)}, 0)"
    judged = ", ".join(f"'{k}', cast({v} as double)" for k, v in features("y.candidate", "y.before", "y.after", path).items())
    # a lambda over a one-element array names a value, so that it is computed once
    return f"""element_at(transform(transform(array(named_struct('found', {made}, 'cut', {cut})), z -> named_struct('found', z.found, 'cut', z.cut, 'places', {places("z.found", "z.cut")})), z -> named_struct('cut', z.cut, 'found',
        transform(transform(filter(sequence(0, size(z.found)), i -> i > 0), i -> named_struct('nth', i, 'candidate', element_at(z.found, i), 'before', right(element_at(z.cut, i), {BEFORE}), 'after', left(element_at(z.cut, i + 1), {AFTER}), 'start', element_at(z.places, i))),
            y -> named_struct('nth', y.nth, 'candidate', y.candidate, 'before', y.before, 'after', y.after, 'start', y.start, 'score', element_at(transform(array(named_struct({judged})), x -> {forest}), 1))))), 1)"""


def path_of(documents: DataFrame, path_col: str | None) -> Column:
    return F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col and path_col in documents.columns else F.lit("")


def scan(documents: DataFrame, findings_labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """doc_id, nth, candidate, start, score, is_secret: every candidate with the forest's verdict.

    nth counts from 1 within a text; start is the candidate's place, in characters from 1. Null and empty texts have no
    candidates. A null path counts as empty, and so does one without its column. Null ids and repeated rows stay, and a
    candidate that stands there twice is two. At one place the first kind of the pattern counts. Narrow: no shuffle.
    """
    forest = forest_of(documents.sparkSession, findings_labelled)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), path_of(documents, path_col).alias("path"))
    some = docs.filter(F.col("text").rlike(PATTERN))
    found = some.select("doc_id", F.explode(F.expr(findings("text", "path", forest))["found"]).alias("f"))
    return found.select("doc_id", F.col("f.nth").alias("nth"), F.col("f.candidate").alias("candidate"), F.col("f.start").alias("start"), F.col("f.score").alias("score"), (F.col("f.score") >= THRESHOLD).alias("is_secret"))


def redact(documents: DataFrame, findings_labelled: DataFrame | None = None, text_col: str = "text", path_col: str | None = "source", mark: str = "[SECRET]") -> DataFrame:
    """documents, all columns and rows, with mark at the place of each secret.

    A candidate that the forest calls a secret once is one wherever it is a candidate in that text; its characters
    inside another word stay.
    Null and empty texts stay as they are, ids are not looked at, repeated rows change alike. Columns may have any names.
    """
    forest = forest_of(documents.sparkSession, findings_labelled)
    columns = documents.columns
    inner = documents.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"), path_of(documents, path_col).alias("path"))
    secrets = f"array_distinct(transform(filter(f.found, y -> y.score >= {THRESHOLD}D), y -> y.candidate))"
    pieces = f"element_at(transform(transform(array({findings('text', 'path', forest)}), f -> named_struct('cut', f.cut, 'found', f.found, 'secrets', {secrets})), f -> array_join(transform(f.cut, (c, i) -> concat(c, CASE WHEN i >= size(f.found) THEN '' WHEN array_contains(f.secrets, f.found[i].candidate) THEN {quoted(mark)} ELSE f.found[i].candidate END)), '')), 1)"
    cleaned = F.when(F.col("text").rlike(PATTERN), F.expr(pieces)).otherwise(F.col("text"))
    return inner.select(*((cleaned if c == text_col else F.col("row").getField(c)).alias(c) for c in columns))
