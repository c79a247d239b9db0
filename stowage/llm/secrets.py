"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame functions throughout.

A candidate is a value assigned to a name such as token or password, what follows the words of an authorization header, the
password of a user in a URL, a key of a known provider, a long run of key characters with a digit in it, or a private key
from its BEGIN to its END line. The pattern takes time in proportion to a text's length, whatever the text. Its features are its length, the
transitions between kinds of characters, how much of it dictionary words cover (the corpus' own most frequent words,
counted over all documents, and a short fixed list), what makes it look like a path, and words beside it. The forest is
grown on the driver from a table of labelled findings of bounded size, and becomes one column expression, so scanning and
redaction are projections without any shuffle. No findings labelled by people come with the tables: the default ones are
made by a rule; a quarter of them is held out from growing, and ``held_out_quality`` measures the forest on these. Others
can be given.

Cases: null and empty texts have no candidates and stay as they are; the noncharacters U+FDD0 and U+FDD1, which mark
candidates, count as U+FDD2 in a text with candidates; repeated rows have their findings each; an empty table gives no
rows; other columns stay as they are in ``redacted`` and are ignored in ``findings``. Texts are read whole.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE, OTHER = "﷐", "﷑", "﷒"
NAMES = "token|secret|passwords?|passwd|pwd|(?:api|access|auth|account|secret|signing|encryption|session|service)[_-]?key|client[_-]?secret|credentials?"
ASSIGNED = rf"(?i:(?<![a-z])(?:[a-z0-9]{{1,20}}[_-]){{0,3}}(?:{NAMES})[\"']?\s{{0,4}}[:=]\s{{0,4}}[\"']?)"
#: What follows the words of an authorization header, and the password of a user in a URL; each begins a candidate.
HEADER = r"(?i:(?<![a-z])(?:authorization[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?(?:[a-z]{1,12}[ \t]{1,4})?|(?:bearer|basic)[ \t]{1,4}))"
LOGIN = rf"://[^\s/:@\"'<>{OPEN}{CLOSE}]{{0,64}}:"
#: Keys of known providers; one begins a candidate of its own wherever it stands, also within a URL or another value. Those that
#: run on to a part that may be missing begin only where a run begins, so that no run is looked through from each of its places.
_START = r"(?:(?<![A-Za-z0-9])|(?<=%[0-9A-Fa-f]{2})|(?<=\\[nrt]))"
_RUN_START = r"(?:(?<![A-Za-z0-9_-])|(?<=%[0-9A-Fa-f]{2})|(?<=\\[nrt]))"
KNOWN = (
    rf"(?:{_START}(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{{30,}}+|xox[abprs]-[A-Za-z0-9-]{{10,}}+|AIza[0-9A-Za-z_-]{{30,}}+|hooks\.slack\.com/services/[A-Za-z0-9/]{{20,}}+)"
    rf"|{_RUN_START}(?:sk-(?=[a-z_-]*+[A-Z0-9])[A-Za-z0-9_-]{{20,}}+|eyJ[A-Za-z0-9_-]{{8,}}+(?:\.[A-Za-z0-9_-]*+){{1,4}}+))"
)
#: A run ends at "=", so that the value of NAME=VALUE stands alone; the padding of base64 belongs to it.
RUN = rf"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_.-]*+[0-9])(?:(?!{KNOWN})[A-Za-z0-9+/_.-]){{20,}}+(?:={{1,2}}(?![A-Za-z0-9+/_=.-]))?"
#: A private key up to its END line; without one, over the lines of base64 that follow (the last may be short), with line
#: ends as such or escaped, quotes and comment marks around them. No other BEGIN lies within.
_BREAK = r"[ \t\"',;+\\]*+(?:\r?\n|(?<=\\)n|(?<=\\)r\\n)[ \t>#*|\"'/]*?"
_LINE_END = r"(?=[ \t\"',;+\\]*(?:[\r\n]|\z|(?<=\\)[rn]))"
PRIVATE = (
    r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,24}PRIVATE KEY-----"
    rf"|(?:{_BREAK}(?:Proc-Type|DEK-Info): [^\r\n\\]*+)*(?:{_BREAK}{_LINE_END})?"
    rf"(?:(?:{_BREAK}[A-Za-z0-9+/]{{16,}}={{0,2}}{_LINE_END}|\s++[A-Za-z0-9+/]{{24,}}={{0,2}})++(?:{_BREAK}[A-Za-z0-9+/]{{1,15}}={{0,2}}{_LINE_END})?)?)"
)
VALUE = rf"[^\s\"'{OPEN}{CLOSE}](?:(?!{KNOWN})[^\s\"'{OPEN}{CLOSE}]){{5,}}+"
#: Most places of a text follow a letter, where only a login or a private key can begin; what else may is looked for at the others alone.
_PLACE = r"(?:(?<![A-Za-z])|(?<=\\[nrt])|(?<=%[0-9A-Fa-f]{2}))"
CANDIDATE = (
    rf"{_PLACE}(?:{ASSIGNED}(?:{PRIVATE}|{VALUE})|{HEADER}[A-Za-z0-9+/_.~-]{{12,}}+={{0,2}}|{KNOWN}|{RUN})"
    rf"|{LOGIN}[^\s/:@\"'<>{OPEN}{CLOSE}]{{3,128}}+(?=@)|{PRIVATE}"
)
#: What a candidate is assigned to or follows, and isn't part of its value.
PREFIX = rf"(?:{ASSIGNED}|{HEADER}|{LOGIN})"
#: Characters on each side of a candidate that its neighbouring words are looked for in.
CONTEXT = 48
#: Rows of labelled findings that the forest is grown from, and its shape.
LABELLED, TREES, DEPTH, LEAST_ROWS, SEED = 6000, 15, 7, 4, 11
#: Words of the corpus that the dictionary has at most.
DICTIONARY = 1000
#: Common words for the dictionary coverage (fixed list).
WORDS = (
    "the and for that with this from have your here enter insert change example sample dummy test value name user email token secret password "
    "key access public private none null true false required optional default string number file path home local usr lib bin src main index page "
    "section chapter report version release build update image video photo article post content data table model config settings module class function "
    "method request response server client service system admin login logout account session cookie date time year month day january february march april "
    "may june july august september october november december monday friday word text line tokenizer vocab count size length long short left right top "
    "first last next previous new old open close start stop begin end high low good best more less world house water people place state city country"
).split()
FEATURES = ("length", "transitions", "distinct", "digits", "capitals", "covered", "slashes", "extension", "assigned", "named", "benign", "quoted", "known", "hyphens", "login", "password", "code", "tagged", "keyed")


def prefix_of(candidate: Column) -> Column:
    return F.regexp_extract(candidate, rf"^({PREFIX})", 1)


def value_of(candidate: Column) -> Column:
    """The candidate without what stands before its value and without closing marks."""
    return F.regexp_replace(F.regexp_replace(candidate, rf"^{PREFIX}", ""), r"[;,.)\]}>#*$%&|!]+$", "")


def learned_words(docs: DataFrame, most: int = DICTIONARY) -> list[str]:
    """The most frequent words of four letters or more, counted over all texts; ties by the word."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,20}"), F.lit(0))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(most).collect())


def dictionary(words: Iterable[str] = ()) -> str:
    """A pattern of the given words and the fixed ones, the longer first, by their first letters."""
    by: dict[str, list[str]] = {}
    for w in sorted({*words, *(w for w in WORDS if len(w) > 2)}, key=lambda w: (-len(w), w)):
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by.items()))


def features(candidate: Column, before: Column, after: Column, words: str) -> dict[str, Column]:
    value, name = value_of(candidate), prefix_of(candidate)
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    near = F.lower(F.concat(before, name))
    flag = lambda c: c.cast("double")
    return {
        "length": n,
        "transitions": share("(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(40.0)),
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "covered": 1 - F.length(F.regexp_replace(F.lower(value), words, "")) / n,
        "slashes": share(r"[/\\.]"),
        "extension": flag(value.rlike(r"\.[A-Za-z]{2,5}$")),
        "assigned": flag(name.rlike(rf"^{ASSIGNED}")),
        "named": flag(near.rlike(rf"(?:{NAMES}|bearer|private|authorization)\W{{0,6}}$")),
        "benign": flag(near.rlike(r"(?:commit|(?:sha-?\d*|md5)(?:sums?)?|integrity|base64|checksum|digest|hash|uuid|id|version|build|example|sample|https?://\S*|revision|file|path|isbn|order|page)\W{0,6}$")),
        "quoted": flag(F.concat(before, name).rlike(r"[\"'`]\z") & after.rlike(r"^[\"'`]")),
        "known": flag(value.rlike(rf"^{KNOWN}|PRIVATE KEY")),
        "hyphens": share("[_-]"),
        "login": flag(name.rlike(rf"^(?:{HEADER}|{LOGIN})")),
        "password": flag(name.rlike(r"(?i:passw|pwd|://)")),
        "tagged": flag(value.rlike(r"^[A-Za-z]{2,7}(?:[_-][a-z0-9]{1,5})?[_.-][A-Za-z0-9_.-]{16,}+$")),
        "keyed": flag(F.concat(before, name).rlike(r"(?i:key|token|secret|auth|cred|passw|pwd)[^\n]{0,12}$|[A-Z][A-Z0-9_]{2,20}=[\"']?$")),
        "code": flag(value.rlike(r"[(\[{$<]|^[A-Za-z_]++(?:\.[A-Za-z_]++)+$")),
    }


def labelled_findings(spark: SparkSession) -> DataFrame:
    """kind, candidate, before, after, label, held_out: findings of known kinds, made from hashes of their numbers; LABELLED rows."""
    n = F.col("id")
    hexes = F.sha2(F.concat(F.lit("finding"), n), 256)
    base = F.concat(F.base64(F.unhex(F.sha2(hexes, 256))), F.base64(F.unhex(hexes)), F.base64(F.unhex(F.sha2(hexes, 512))))
    letters = F.regexp_replace(base, "[^A-Za-z0-9]", "")
    of = lambda salt, *options: F.element_at(F.array(*[F.lit(o) if isinstance(o, str) else o for o in options]), (F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(len(options))) + 1).cast("int"))
    word = lambda i: of(f"w{i}", *[w for w in WORDS if len(w) > 2])
    cut = lambda text, size: F.substr(text, F.lit(1), size.cast("int") if isinstance(size, Column) else F.lit(size))
    join = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    number = F.pmod(F.xxhash64(n), F.lit(10**9)).cast("string")
    spread = lambda salt, least, most: F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(most - least + 1)) + least
    size = spread("size", 20, 43)
    uuid = F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))
    name = of("n", "token", "secret", "password", "api_key", "access_key", "client_secret", "pwd", "auth_key", "db_password", "my-api-key", "SECRET_KEY", "API_TOKEN")
    equals = of("a", " = ", "=", ": ", ":")
    assign, quote = F.concat(name, equals), of("q", '"', "'", "", '"')
    filler = of("f", "set the ", "use ", "and then ", "it was\n", "config: ", "with ")
    amazon = F.concat(of("ak", "AKIA", "ASIA"), F.upper(of("al", cut(hexes, 16), F.translate(cut(hexes, 16), "0123456789", "qwzuiopghk"))))
    secret = of("v", cut(hexes, 40), cut(hexes, 32), hexes, cut(letters, size), join("ghp_", cut(letters, 36)), amazon, cut(letters, 12), join(cut(letters, 5), "-", F.substring(letters, 6, 9)), join("sk-", cut(letters, 40)))
    pem = join("-----BEGIN PRIVATE KEY-----\n", F.repeat(join(cut(letters, 64), "\n"), (F.pmod(F.xxhash64(n, F.lit("p")), F.lit(26)) + 1).cast("int")), "-----END PRIVATE KEY-----")
    loose = of("l", join("ghp_", cut(letters, 36)), amazon, join("sk-", cut(letters, 40)), join("eyJ", cut(letters, 30), ".", cut(hexes, 30)), "-----BEGIN RSA PRIVATE KEY-----", pem, join("xoxb-", cut(letters, 30)), join("AIza", cut(letters, 35)))
    joint = of("j", "_", "-", ".")
    words = F.concat(word(1), joint, word(2), joint, F.substring(number, 1, 2), joint, word(3), joint, word(4))
    path = join("/", word(1), "/", word(2), "/", word(3), F.substring(number, 1, 2), "/", word(4), of("e", ".py", ".txt", ".html", "", ".json"))
    plain = of("p", "changeme", "your_token_here", "required", "xxxxxxxxxxxx", "example", "<password>", "optional", "********", "none,see-below", "placeholder", "${TOKEN}", "enter-your-key-here", "none;GITHUB_PAT=", "off&next_key=")
    low, few = F.lower(cut(letters, spread("low", 5, 8))), cut(number, spread("few", 1, 4))
    chosen = of("c", join(word(1), F.lpad(few, 2, "4")), join(F.initcap(word(1)), few, of("m", "!", "@", "#", "_")), join(low, few), join(F.initcap(low), "!", few), join(word(1), of("m", "-", "_", "."), word(2), few), join(F.translate(word(1), "aeio", "4310"), "-", few, low), join(cut(letters, 8), of("m", "!", "$", "%", "^"), F.substring(letters, 9, 4)))
    password = F.concat(of("pn", "password", "Password", "passwd", "pwd", "db_password", "DB_PASSWORD", "admin-password"), of("pa", ": ", "=", " = ", ":"))
    env = F.concat(of("en", "AWS_SECRET_ACCESS_KEY", "STRIPE_API_KEY", "NPM_TOKEN", "CLIENT_SECRET", "DJANGO_SECRET_KEY", "storage_account_key", "SIGNING_KEY", "slack_token"), of("ea", "=", "=", ": ", " = "))
    header = of("h", "Authorization: Bearer ", "authorization: bearer ", "Bearer ", "Authorization: token ", "Authorization: ")
    login = join("://", of("u", "admin", "root", "app", "user", word(1), "svc_deploy"), ":")
    vendor = of("vn", join("glpat-", cut(letters, 20)), join("sk_live_", cut(letters, 24)), join("SG.", cut(letters, 22), ".", F.substring(letters, 23, 40)), join("npm_", cut(letters, 36)), join("GOCSPX-", cut(letters, 28)), join("shpat_", cut(hexes, 32)), join("hf_", cut(letters, 34)), join("dop_v1_", hexes), join("key-", cut(hexes, 32)), join("ya29.", cut(letters, 60)))
    syllables = F.translate(cut(hexes, spread("sy", 6, 12)), "0123456789abcdef", "enisratulodmgkcp")
    code = of("cd", "os.environ['KEY']", "getpass()", "self.api_key", "request.form['password']", "config.get(name)", "${{secrets.TOKEN}}", "String.valueOf(x1)", "process.env.SECRET_V2", "args.password", "input('pw2')", "hash(password1)", "user.password")
    kinds = {  # candidate, before, after, label
        "assigned": (F.concat(assign, quote, secret), filler, quote, 1),
        "assigned_hex": (F.concat(assign, quote, cut(hexes, 40)), filler, quote, 1),
        "provider": (loose, of("b", "Authorization: Bearer ", "key ", "use ", "export "), F.lit(" "), 1),
        "provider_within": (loose, of("m", "export AWS_ACCESS_KEY_ID=", "GITHUB_PAT=", "https://site.org/api/js?key=", "\nOPENAI_KEY=", "https://", "id=", "version: ", "file path/"), of("t", "\n", " ", "&v=3", "/", "@site.org"), 1),
        "environment": (F.concat(env, of("eq", "", '"'), cut(base, spread("es", 32, 64))), of("eb", "export ", "\n", "ENV ", "- "), of("ee", "\n", " ", '"'), 1),
        "password": (F.concat(password, quote, chosen), filler, quote, 1),
        "bearer": (F.concat(header, of("hv", cut(letters, size), cut(base, size), hexes, join(cut(letters, 12), "-", F.substring(letters, 13, 14)))), of("hb", "curl -H '", "\n", "header ", "sent "), of("ha", "'", "\n", " "), 1),
        "basic": (join(of("hb2", "Authorization: Basic ", "Basic ", "authorization: basic "), F.base64(F.encode(join(word(1), ":", chosen, low), "UTF-8"))), of("hb", "curl -H '", "\n", "header ", "sent "), of("ha", "'", "\n", " "), 1),
        "url_login": (F.concat(login, of("lv", F.translate(chosen, "@#%$^", "xyzuv"), cut(letters, 16), cut(hexes, 12))), of("lb", "postgres", "mysql", "DATABASE_URL=postgresql", "redis", "https", "amqp"), of("la", "@db.site.org:5432/app", "@localhost/", "@10.0.0.4:6379", "@mail.site.org"), 1),
        "webhook": (join("hooks.slack.com/services/T", F.upper(cut(hexes, 8)), "/B", F.upper(F.substring(hexes, 9, 8)), "/", cut(letters, 24)), of("wb", "https://", "post to https://", 'url: "https://'), of("wa", " ", '"', "\n"), 1),
        "vendor": (vendor, of("vb", "STRIPE=", "the key ", "use ", "\n", 'apikey", "', "export X=", "id: "), of("va", " ", "\n", '"'), 1),
        "placeholder": (F.concat(assign, quote, plain), filler, quote, 0),
        "assigned_words": (F.concat(assign, quote, words), filler, quote, 0),
        "assigned_code": (F.concat(assign, code), filler, F.lit("\n"), 0),
        "assigned_word": (F.concat(assign, quote, of("aw", syllables, F.initcap(syllables), join(syllables, "-", word(1)))), filler, quote, 0),
        "commit": (cut(hexes, 40), of("b", "commit ", "sha1 ", "at revision "), F.lit(" "), 0),
        "digest": (of("h0", hexes, cut(hexes, 32)), of("b", "sha256:", "checksum ", "md5 ", "digest: ", "hash ", "MD5SUM=", "SHA256=", "CHECKSUM="), F.lit("\n"), 0),
        "uuid": (uuid, of("b", "id=", "uuid ", "the order ", "see "), F.lit(" "), 0),
        "path": (path, of("b", "see ", "file ", "https://site.org", "open "), F.lit(" "), 0),
        "words": (words, of("b", "the ", "page ", "see "), F.lit(" "), 0),
        "number": (F.concat(number, number, number), of("b", "call ", "isbn ", "order ", "number "), F.lit(" "), 0),
        "url_part": (cut(letters, size), of("b", "https://site.org/watch?v=", "page ", "image ", "and ", "of the "), F.lit(" "), 0),
        "inline_data": (cut(base, spread("is", 60, 170)), of("b", "data:image/png;base64,", 'integrity="sha512-', "data:font/woff2;base64,"), of("t0", '"', ")", "'"), 0),
        "package": (join(word(1), "-", cut(number, 1), ".", F.substring(number, 2, 2), ".", F.substring(number, 4, 1), of("pk", "-linux-x86_64.tar.gz", "-py3-none-any.whl", ".min.js", "-amd64.deb", "-SNAPSHOT.jar")), of("b", "install ", "https://site.org/files/", "get ", "- "), of("t1", " ", "\n"), 0),
        "header_words": (F.concat(of("hw", "basic ", "bearer ", "Basic "), word(1), of("hj", "-", "_", ""), word(2), of("hk", "-", "_", ""), word(3), word(4)), of("b", "the ", "a ", "some "), F.lit(" "), 0),
        "login_placeholder": (join("://", of("lu", "user", "username", "USER", "<user>"), ":", of("lp", "password", "pass", "PASSWORD", "secret", "yourpassword", "${DB_PASS}", "<pass>", "xxxx", "*****")), of("lb", "postgres", "mysql", "https", "redis"), of("lz", "@host/db", "@localhost", "@example.com"), 0),
        "identifier": (F.concat(F.initcap(word(1)), F.initcap(word(2)), F.initcap(word(3)), F.initcap(word(4)), cut(number, 1)), of("b", "class ", "the ", "new ", "see "), F.lit(" "), 0),
    }
    made = F.element_at(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("candidate"), b.alias("before"), a.alias("after"), F.lit(y).alias("label")) for k, (c, b, a, y) in kinds.items()]), (F.pmod(n, F.lit(len(kinds))) + 1).cast("int"))
    return spark.range(LABELLED).select(made.alias("f"), (F.pmod(F.xxhash64(n, F.lit("held out")), F.lit(4)) == 0).alias("held_out")).select("f.*", "held_out")


def grow(rows: list[tuple[tuple[float, ...], int]], depth: int, pick: random.Random) -> tuple | float:
    """A tree: (feature, cut, low side, high side) or a leaf's share of positives. Each split looks at a few features."""
    positives = sum(y for _, y in rows)
    if not depth or positives in (0, len(rows)) or len(rows) < 2 * LEAST_ROWS:
        return positives / len(rows)
    best = None
    for f in pick.sample(range(len(FEATURES)), 6):
        ordered = sorted((x[f], y) for x, y in rows)
        left = 0
        for i in range(1, len(ordered)):
            left += ordered[i - 1][1]
            if ordered[i][0] == ordered[i - 1][0] or i < LEAST_ROWS or len(rows) - i < LEAST_ROWS:
                continue
            right = positives - left
            impurity = left * (i - left) / i + right * (len(rows) - i - right) / (len(rows) - i)
            if best is None or impurity < best[0]:
                best = impurity, f, (ordered[i][0] + ordered[i - 1][0]) / 2
    if best is None:
        return positives / len(rows)
    _, f, cut = best
    return f, cut, grow([r for r in rows if r[0][f] <= cut], depth - 1, pick), grow([r for r in rows if r[0][f] > cut], depth - 1, pick)


_forests: dict[tuple[str, str], list] = {}


def measured(labelled: DataFrame, words: str) -> DataFrame:
    each = features(F.col("candidate"), F.col("before"), F.col("after"), words)
    return labelled.select(*[each[f].cast("double").alias(f) for f in FEATURES], "label", "held_out")


def forest(spark: SparkSession, words: str, labelled: DataFrame | None = None) -> list:
    """Trees grown on bootstrap samples of the labelled findings that aren't held out (bounded: ``labelled`` has LABELLED rows, about, at most)."""
    key = spark.sparkContext.applicationId, words
    if labelled is not None or key not in _forests:
        rows = measured(labelled_findings(spark) if labelled is None else labelled, words).filter("NOT held_out").drop("held_out").coalesce(1).collect()
        data = sorted((tuple(round(v, 6) for v in r[:-1]), r[-1]) for r in rows)
        pick = random.Random(SEED)
        trees = [grow(pick.choices(data, k=len(data)), DEPTH, pick) for _ in range(TREES)]
        if labelled is not None:
            return trees
        _forests[key] = trees
    return _forests[key]


def held_out_quality(spark: SparkSession, words: str, labelled: DataFrame | None = None, threshold: float = 0.5) -> dict[str, float]:
    """Precision and recall of the forest on the labelled findings that it wasn't grown from."""
    rows = measured(labelled_findings(spark) if labelled is None else labelled, words).filter("held_out")
    said = rows.select("label", voted(forest(spark, words, labelled), F.struct(*FEATURES), threshold).alias("said"))
    r = said.agg(F.count_if(F.col("said") & (F.col("label") == 1)).alias("right"), F.count_if("said").alias("said"), F.count_if(F.col("label") == 1).alias("real"), F.count(F.lit(1)).alias("n")).first()
    return {"precision": r["right"] / max(1, r["said"]), "recall": r["right"] / max(1, r["real"]), "findings": r["n"]}


def quality_by_kind(spark: SparkSession, words: str, kinds: Sequence[str] = (), threshold: float = 0.5) -> dict[str, tuple[int, float]]:
    """label and the share judged right of each of ``kinds`` (all of them where none are given), by a forest that was grown without that kind."""
    every = labelled_findings(spark)
    out = {}
    for kind in kinds or sorted(r["kind"] for r in every.select("kind").distinct().collect()):  # as many as there are kinds
        trees = forest(spark, words, every.withColumn("held_out", F.col("kind") == kind))
        each = features(F.col("candidate"), F.col("before"), F.col("after"), words)
        at = every.filter(F.col("kind") == kind).select("kind", "label", F.struct(*[each[f].cast("double").alias(f) for f in FEATURES]).alias("x"))
        said = at.withColumn("right", voted(trees, F.col("x"), threshold) == (F.col("label") == 1))
        out |= {r["kind"]: (r["label"], r["share"]) for r in said.groupBy("kind", "label").agg(F.avg(F.col("right").cast("double")).alias("share")).collect()}
    return out


def tree_column(tree: tuple | float, at: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, low, high = tree
    return F.when(at[FEATURES[f]] <= cut, tree_column(low, at)).otherwise(tree_column(high, at))


def probability(trees: list, at: Column) -> Column:
    return reduce(lambda a, b: a + b, [tree_column(t, at) for t in trees]) / len(trees)


def voted(trees: list, at: Column, threshold: float) -> Column:
    """Whether the forest says so, as a function over an array, which has no compiled form that could grow too large."""
    return F.exists(F.array(at), lambda x: probability(trees, x) >= threshold)


def scanned(docs: DataFrame, threshold: float = 0.5, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` (text and columns of other names than pieces, found and kept) with pieces (the text before, between and after candidates), found
    (one entry a candidate) and kept (which of them are secrets)."""
    words = dictionary(learned_words(docs))
    trees = forest(docs.sparkSession, words, labelled)
    clear = F.when(F.col("text").contains(OPEN) | F.col("text").contains(CLOSE), F.translate("text", OPEN + CLOSE, OTHER + OTHER)).otherwise(F.col("text"))
    pieces = F.split(F.regexp_replace(clear, f"({CANDIDATE})", f"{OPEN}$1{CLOSE}"), OPEN)
    rest = lambda p: F.when(F.instr(p, CLOSE) > 0, F.substring_index(p, CLOSE, -1)).otherwise(p)

    def look(p: Column, i: Column) -> Column:
        return F.struct(
            i.alias("ordinal"),
            F.substring_index(p, CLOSE, 1).alias("candidate"),
            F.substring(F.right(rest(F.element_at(F.col("pieces"), i + 1)), F.lit(CONTEXT)), 1, CONTEXT).alias("before"),
            F.substring(rest(p), 1, CONTEXT).alias("after"),
        )

    def measure(c: Column) -> Column:
        each = features(c["candidate"], c["before"], c["after"], words)
        return F.struct(c["ordinal"].alias("ordinal"), c["candidate"].alias("candidate"), c["before"].alias("before"), c["after"].alias("after"), *[each[f].cast("double").alias(f) for f in FEATURES])

    def judge(c: Column) -> Column:
        return F.struct(c["ordinal"].alias("ordinal"), c["candidate"].alias("candidate"), c["before"].alias("before"), c["after"].alias("after"), probability(trees, c).alias("probability"))

    tail = lambda: F.slice("pieces", 2, F.greatest(F.size("pieces") - 1, F.lit(0)))
    seen = docs.withColumn("pieces", pieces).withColumn("found", F.transform(tail(), look))
    return seen.withColumn("found", F.transform(F.transform("found", measure), judge)).withColumn("kept", F.transform("found", lambda c: c["probability"] >= threshold))


def findings(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, ordinal (of the candidate in its text), kind, secret, before, probability, is_secret of every candidate."""
    found = scanned(docs.select(F.col("doc_id").cast("long"), "text"), threshold).filter(F.size("found") > 0).select("doc_id", F.explode("found").alias("f"))
    kind = F.when(F.col("f.candidate").rlike(PRIVATE), "private_key").when(F.col("f.candidate").rlike(rf"^(?:{HEADER}|{LOGIN})"), "login").when(F.length(prefix_of(F.col("f.candidate"))) > 0, "assigned").otherwise("run")
    return found.select(
        "doc_id", "f.ordinal", kind.alias("kind"), value_of(F.col("f.candidate")).alias("secret"), "f.before", F.round("f.probability", 6).alias("probability"), (F.col("f.probability") >= threshold).alias("is_secret")
    )


def redacted(docs: DataFrame, threshold: float = 0.5, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets replaced by ``mask`` in text, and n_chars (where there is one) of the new text."""
    columns = docs.columns
    own = [f"own{i}" for i in range(len(columns))]
    seen = scanned(docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(columns, own, strict=True)], F.col("text")), threshold)

    def put(p: Column, i: Column) -> Column:
        """The piece after a candidate, with the candidate as it is or masked before it."""
        candidate = F.substring_index(p, CLOSE, 1)
        name, value = prefix_of(candidate), value_of(candidate)
        closing = F.substring(candidate, F.length(name) + F.length(value) + 1, F.length(candidate))
        masked = F.when(F.element_at(F.col("kept"), i + 1), F.concat(name, F.lit(mask), closing)).otherwise(candidate)
        return F.concat(masked, F.substring_index(p, CLOSE, -1))

    rebuilt = F.concat(F.element_at("pieces", 1), F.array_join(F.transform(F.slice("pieces", 2, F.greatest(F.size("pieces") - 1, F.lit(0))), put), ""))
    changed = F.exists("kept", lambda k: k)
    text = F.when(changed, rebuilt).otherwise(F.col("text"))
    out = {c: F.col(o) for c, o in zip(columns, own, strict=True)} | {"text": text}
    if "n_chars" in columns:
        out["n_chars"] = F.when(changed, F.length(text)).otherwise(out["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return seen.select(*[v.alias(c) for c, v in out.items()])
