"""Secret scan with DataFrame functions alone; a random forest removes false positives.

Candidates are runs of key-like characters, and whatever follows a secret's name. Their features (length, character
transitions, dictionary coverage, path and neighbouring words) are SQL expressions over arrays, and
the forest, fitted once on labelled findings, becomes one SQL expression too: a text is scanned,
judged and redacted within its own row, without a shuffle.
"""

from __future__ import annotations

import random
import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captionloom.llm.common import named

CONTEXT = 40
MASK = "[SECRET]"
#: Code points that are no characters: to mark candidates in a text, and to write marks that stand there already.
MARK, ESCAPE, IS_MARK, IS_ESCAPE = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"

#: Names that announce a secret or something else, issuers' prefixes, words of plain text.
SECRET_NAMES = "token|secret|passw(?:or)?d|passwd|passphrase|pass|pwd|account[_ -]?key|api[_ -]?key|access[_ -]?key|auth|bearer|credential|private[_ -]?key|client[_ -]?secret|secret[_ -]?key"
OTHER_NAMES = "sha(?:1|256)?|md5|commit|checksum|hash|uuid|guid|id|iban|phone|tel|isbn|doi|version|build|url|mail|fax|card"
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|sk_test_|rk_live_|xox[abpr]-|AIza|eyJ|SG\\.|npm_|pypi-"
#: What a candidate with an issuer's mark starts with.
ISSUED = f"{PREFIXES}|-----BEGIN "
PLAIN = "example|sample|test|dummy|placeholder|change|your|insert|mail|http|www|com|org|net|html|version|release|the|and|ing|tion|er|on|re|in|at|en|es|or|de|an|ti|st|al|le|ou|ch|ie|qu"
#: Words of four letters or more that names, paths and placeholders are made of.
WORDS = "about access account action address after android answer application array backup base before board body book build cache change check child class client cloud code color column command comment config connect content context control count create custom data database date debug default delete demo device document domain download editor email entry error event example export feature file filter find format frame from function group header hello home house image import index info input install interface item java json label language level library license light line link list load local login mail main master media member message method mode model module name network node none null number object online open option order output page password path pattern people phone photo placeholder post price print private process product project public query read record remote request reset response result return sample schema school screen script search secret section secure select server service session setting share simple size source space staple start state status step storage store string style submit support switch system table target task team template test text thing time title token total track transfer type unit update upload user value version video view water window with word work world write your".split()
TEST_PATH = "test|spec|example|sample|fixture|mock|doc|readme"

#: Ends of names by length, as look-behinds of one width are all that Python's expressions have: secrets' and others'.
#: `pass` is one only before a colon or an equals sign.
SECRET_ENDS = {3: "pwd", 4: "auth|pass(?=[ \"'`]{0,2}[:=])", 5: "token", 6: "secret|passwd|bearer|apikey", 7: "api[_ -]key", 8: "password", 9: "accesskey|secretkey", 10: "access[_ -]key|secret[_ -]key|privatekey|credential|accountkey|passphrase", 11: "private[_ -]key|account[_ -]key"}
OTHER_ENDS = ("id", "key|md5|url|doi|tel|fax", "sha1|hash|uuid|guid|iban|isbn|mail|card", "build|phone", "sha256|commit", "version", "checksum")


def _any_of(words: list[str]) -> str:
    """An expression for any of the words, the longest first, by their first letter: most places fail at that."""
    by_letter = {x: sorted((w[1:] for w in words if w[0] == x), key=lambda w: (-len(w), w)) for x in sorted({w[0] for w in words})}
    return "|".join(f"{x}(?:{'|'.join(rest)})" for x, rest in by_letter.items())


DICTIONARY = _any_of(WORDS)


def _candidate() -> str:
    """A candidate is one of, all of it and no part:

    - a private key's block of lines from BEGIN to END;
    - after a secret's name and any signs between (more than six of them if there is white space):
      whatever has no white space, quote or angle bracket, of any length, up to a comma, semicolon or
      ampersand before the next name;
    - the password in a location with a user's name (`scheme://user:password@host`);
    - a run of key-like characters with an issuer's prefix;
    - any other such run of 12 characters or more, except a name without a digit (left to the context of its value).

    Groups 1 and 3 are what stands before a candidate and belongs to the match, groups 2 and 4 then are
    the candidate; otherwise group 5 is. What most places in a text fail comes first: a name's last letter, a prefix's
    first, the length.
    """
    key, inner, signs = r"[A-Za-z0-9+/_\-]", r"[A-Za-z0-9+/_.\-]", "[ \t:=>\"'`]"
    # Beyond ASCII everything but general and ideographic punctuation.
    beyond = "\u00a1-\u1fff\u2070-\u2fff\u3040-\ufdcf\ufdd1-\U0010ffff"
    free, last = r"[!#-%(-+\--:=?-\[\]-_a-~" + beyond + "]", r"[!#-%(*+\-/-9=@-\[^_a-|~" + beyond + "]"
    block = r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----(?:[\t\n\r -,.-~]|-(?!----))*+-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----"
    after = "|".join(f"(?<=[DEHLNRSTYdehlnrsty]{signs}{{{k}}})(?:" + "|".join(f"(?<=(?i:{ends}){signs}{{{k}}})" for ends in SECRET_ENDS.values()) + ")" for k in range(1, 7))
    value = rf"(?![:=]|(?i:{SECRET_NAMES}){signs}){free}*{last}(?:[,;&](?![A-Za-z0-9_.\-]*+=){free}*{last})*+"
    named = rf"(?<={signs})(?:{after}){value}"
    every = "|".join(f"(?<=(?i:{ends}))" for ends in SECRET_ENDS.values())
    far = rf"(?<=[DEHLNRSTYdehlnrsty])(?={signs}{{7}})(?:{every}){signs}*+"
    login = r"://[^\s:/@\"'<>]*+:(?=[^\s/@\"'<>]++@)"
    ends = "".join(f"(?<!(?i:{e}))" for e in SECRET_ENDS.values())
    others = "".join(f"(?<!(?i:{e}))" for e in OTHER_ENDS)
    digit, no_name = r"(?=[A-Za-z+/_.\-]*+[0-9])", rf"(?=[A-Za-z+/_.\-]*+{ends}(?:{others}|(?![\"'`]? ?[:=])))"
    first = "".join(sorted({x[0] for x in PREFIXES.split("|")}))
    run = rf"(?:(?=[{first}])(?:{PREFIXES}){inner}+|(?={key}{inner}{{11}})(?:{digit}|{no_name}){key}{inner}{{11,}})(?<!\.)(?!{key})={{0,2}}"
    return rf"({far})({value})|({login})([^\s/@\"'<>]++)|({block}|{named}|(?<!{key}){run})"


CANDIDATE = _candidate()

FEATURES = ("size", "digits", "upper", "lower", "runs", "distinct", "pairs", "plain", "dictionary", "hex", "only_digits", "dots", "dashes", "prefixed", "named", "other", "quoted", "assigned", "mail", "iban", "worded", "test_path", "login")
TREES, DEPTH, SEED = 24, 6, 7

#: Bound of the labelled findings that are fitted.
FINDINGS = 4_000


def _features(c: Column, left: Column, right: Column, path: Column) -> Column:
    size = F.length(c).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(c, pattern, "")) / size
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    like = lambda x, pattern: flag(x.rlike(pattern))
    made = {
        "size": F.least(size, F.lit(200.0)),
        "digits": share("[^0-9]"),
        "upper": share("[^A-Z]"),
        "lower": share("[^a-z]"),
        "runs": F.regexp_count(c, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")) / size,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / size,
        "pairs": F.regexp_count(F.lower(c), F.lit("[aeiou][bcdfghjklmnpqrstvwxyz]")) / size,
        "plain": 1 - F.length(F.regexp_replace(F.lower(c), PLAIN, "")) / size,
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(c), DICTIONARY, "")) / size,
        "hex": like(c, "^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "only_digits": like(c, "^[0-9.+/_-]+$"),
        "dots": share("[^.]"),
        "dashes": share("[^-/_]"),
        "prefixed": like(c, f"^(?:{ISSUED})"),
        "named": like(left, f"(?i)(?:{SECRET_NAMES})[\"' ]{{0,2}}[ :=>]{{0,4}}[\"']?\\z"),
        "other": like(left, f"(?i)\\b(?:{OTHER_NAMES})[\"' ]{{0,2}}[ :=#>]{{0,4}}[\"']?\\z"),
        "quoted": flag(left.rlike("[\"'`]\\z") & right.rlike("^[\"'`]")),
        "assigned": like(left, "[:=] ?[\"'`]?\\z"),
        "mail": flag(left.endswith("@") | right.startswith("@")),
        "iban": like(c, "^[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{6,}"),
        "worded": like(left, r"[\p{Ll}.,;|] \z"),
        "test_path": like(path, f"(?i)(?:{TEST_PATH})"),
        "login": flag(left.rlike("://[^\\s:/@]*:\\z") & right.startswith("@")),
    }
    return F.struct(*[made[k].alias(k) for k in FEATURES])


def labelled_findings(rows: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """(left, candidate, right, path, label): public formats of secrets and of what is mistaken for them."""
    r = random.Random(seed)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    hexa, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    parts = PLAIN.split("|")
    word = lambda lo=1, hi=4: "".join(r.choice(parts) for _ in range(r.randint(lo, hi)))
    prose = lambda: " ".join(word() for _ in range(r.randint(1, 4))) + r.choice([" ", " ", ". ", ", ", "\n", " | "])
    names = ["pass", "DB_PASS", "passphrase", "AccountKey", "token", "secret", "password", "passwd", "pwd", "api_key", "apiKey", "access_key", "auth_token", "client_secret", "private_key", "SECRET_KEY", "bearer"]
    others = ["sha1", "sha256", "md5", "commit", "checksum", "uuid", "iban", "id", "version", "build", "phone", "isbn", "etag", "color", "size"]
    paths = ["src/main.py", "app/settings.yaml", "src3", "src0", "web", "tests/test_auth.py", "docs/readme.md", "examples/sample.env", ""]
    glue = lambda: r.choice(["=", " = ", ": ", ":", "=\"", " = \"", ": '", "\": \"", " ", " " * r.randint(3, 20) + "= "])

    syllables = lambda lo, hi: "".join(r.choice("bcdfghjklmnprstvwz") + r.choice("aeiou") + r.choice(["", "", "n", "r", "s", "l"]) for _ in range(r.randint(lo, hi)))
    term = lambda lo, hi: r.choice([word, syllables])(lo, hi)
    sign = lambda: r.choice(["=", " = ", ": ", ":", "=\"", " = \"", ": '", "\": \"", " " * r.randint(3, 20) + "= \""])
    closed = lambda g: g[-1] if g[-1] in "\"'" else r.choice([" ", "\n", " " + word()])

    def secret() -> tuple[str, str, str]:
        kind = r.randrange(13)
        if kind == 12:  # in a location, or in another script
            if r.random() < 0.7:
                body = r.choice([pick(alnum, r.randint(8, 24)), term(1, 3).title() + pick(string.digits + "!$%*", r.randint(2, 5)) + pick(alnum, 4)])
                return prose() + r.choice(["postgres", "mysql", "mongodb+srv", "redis", "https", "amqp", "ftp"]) + "://" + r.choice([term(1, 2), "admin", "root", ""]) + ":", body, "@" + term(1, 3) + r.choice([".example.org/x", ":5432/db", "/"])
            g = sign()
            return prose() + r.choice(names[4:]) + g, "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(r.randint(2, 6))) + pick(alnum + "!@#", r.randint(3, 8)), closed(g)
        if kind == 0 and r.random() < 0.3:
            name = r.choice(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "]) + "PRIVATE KEY"
            return prose() + "\n", f"-----BEGIN {name}-----\n" + "\n".join(pick(b64, 64) for _ in range(r.randint(2, 12))) + f"\n-----END {name}-----", "\n" + word()
        if kind >= 9:  # chosen by people, or short: known by the name before them
            body = ["".join(term(1, 3).title() for _ in range(r.randint(2, 5))), (term(1, 3).title() + pick("!@#$%*?_", r.randint(1, 2)) + pick(string.digits, r.randint(1, 4))).replace("a", r.choice("a@"), 1), pick(alnum + "!@#$%*", r.randint(6, 15)), pick(string.ascii_letters, r.randint(12, 40))][r.randrange(4)]
            g = sign()
            return prose() + r.choice(names) + g, body, closed(g)
        known = [lambda: r.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + "234567", 16), lambda: r.choice(["ghp_", "gho_", "ghs_"]) + pick(alnum, 36), lambda: r.choice(["sk_live_", "rk_live_"]) + pick(alnum, 24), lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24), lambda: "AIza" + pick(alnum + "_-", 35), lambda: "eyJ" + pick(alnum, 30) + "." + pick(alnum, 40) + "." + pick(alnum + "_-", 43), lambda: "glpat-" + pick(alnum + "_-", 20)]
        if kind < 4:
            own = r.choice(known)() if r.random() < 0.8 else r.choice(PREFIXES.split("|")[:2]) + pick(string.ascii_uppercase, 16)
            return (prose(), own, " " + word()) if r.random() < 0.6 else (prose() + r.choice(names) + glue(), own, r.choice(["\"", "'", " ", "\n"]))
        body = [lambda: pick(hexa, r.choice([16, 18, 20, 24, 32, 40, 40, 48, 64])), lambda: pick(r.choice([alnum, alnum, string.ascii_letters]), r.randint(16, 48)), lambda: pick(b64, r.randint(24, 64)) + r.choice(["", "=", "=="]), lambda: word(1, 2).title() + pick(alnum, 10)][r.randrange(4)]()
        g = glue()
        return prose() + r.choice(names) + g, body, (g[-1] if g[-1] in "\"'" else r.choice([" ", "\n", " " + word()]))

    def other() -> tuple[str, str, str]:
        kind = r.randrange(21)
        if kind == 20:  # a location with a placeholder
            return prose() + r.choice(["postgres", "mysql", "redis", "https", "http"]) + "://" + r.choice(["user", "username", "admin", term(1, 2)]) + ":", r.choice(["password", "pass", "pwd", "secret", "xxxx", "****", "$PASSWORD", "${DB_PASS}", "{password}", "%s", "your-password", "changeme", "PASSWORD"]), "@" + r.choice(["localhost", "host", term(1, 3) + ".com"])
        if kind == 18:  # a line of a certificate or of another public block
            return r.choice(["-----BEGIN CERTIFICATE-----\n", "-----BEGIN PUBLIC KEY-----\n", pick(b64, 30) + "\n"]), pick(b64, r.choice([64, 64, 76, r.randint(20, 60)])), "\n" + r.choice([pick(b64, 30), "-----END CERTIFICATE-----", "-----END PUBLIC KEY-----"])
        if kind == 12:
            return r.choice([prose(), " ", " "]), r.choice([str, str.title, str.upper])(term(5, 9))[:30].ljust(12, "e"), r.choice([" ", ", ", ".", ""]) + word()
        if kind == 13:
            return prose() + r.choice(names) + " ", r.choice([str, str.title])(term(1, 6)), r.choice([" ", ", ", "."]) + word()
        if kind in (14, 19):
            g = sign()
            return prose() + r.choice(names) + g, r.choice(["None", "null", "true", "false", "string", "String", "undefined", "required", "*" * r.randint(3, 12), "x" * r.randint(3, 20), "$" + term(2, 3).upper(), "${" + term(2, 4).upper(), term(1, 3), str(r.randint(0, 99)), term(1, 3) + "." + term(2, 4), term(1, 2) + "." + term(1, 3) + "("]), closed(g)
        if kind == 15:
            joint = r.choice("-/_.+")
            return r.choice([prose(), " ", prose() + "/"]), r.choice([joint.join(term(2, 3) for _ in range(r.randint(3, 6))), term(2, 3) + "".join(term(1, 3).title() for _ in range(r.randint(2, 4))), r.choice("-_/+") * r.randint(12, 60), r.choice(string.ascii_letters) * r.randint(12, 200), (term(2, 4) + joint) * 2 + term(2, 4).upper()]), r.choice([" ", "\n", "("]) + word()
        if kind == 16:
            return r.choice([prose(), " "]), r.choice(["npm_", "pypi-", "eyJ", "AIza", "glpat-", "ghp_", "AKIA", "SG."]) + r.choice([term(1, 4), "_".join([word(), word()])]), " " + word()
        if kind == 17:
            return r.choice([prose(), " "]), term(2, 5).upper() + "_" + term(2, 5).upper() + r.choice(["", "_" + term(1, 3).upper()]), r.choice([" ", "=", ": ", ")"]) + word()
        if kind == 0:
            return prose(), pick(string.ascii_uppercase, 2) + pick(string.digits, r.randint(14, 26)), " " + word()
        if kind == 1:
            return prose() + r.choice(["", "@"]), word(1, 2) + str(r.randint(0, 99)) + "." + word(1, 2) + ".com", " " + word()
        if kind == 2:
            return prose(), word(2, 3) + "." + str(r.randint(10, 9999)), "@" + word() + ".com "
        if kind == 3:
            return prose(), ".".join(str(r.randint(100, 255)) for _ in range(4)), r.choice([" ", ":"]) + word()
        if kind == 4:
            return prose() + r.choice(["", "+", "("]), pick(string.digits, r.randint(12, 19)), " " + word()
        if kind == 5:
            return prose() + r.choice(others) + glue(), pick(hexa, r.choice([32, 40, 64])), r.choice(["\"", " ", "\n"])
        if kind == 6:
            u = pick(hexa, 32)
            return prose() + r.choice(["", "uuid ", "id="]), f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}", " " + word()
        if kind == 7:
            return prose() + r.choice(["/", "https://", ""]), "/".join(word(1, 2) for _ in range(3)) + str(r.randint(0, 999)), " " + word()
        if kind == 8:
            return prose(), f"20{r.randint(10, 30)}-{r.randint(10, 12)}-{r.randint(10, 28)}" + r.choice(["", "T" + pick(string.digits, 6)]) + "-" * (r.random() < 0.3) + pick(string.digits, 4), " " + word()
        if kind == 9:
            return prose() + r.choice(names) + glue(), r.choice(["your-token-here-", "example-secret-", "changeme-", "test-password-", "placeholder-key-"]) + str(r.randint(1, 9999)), r.choice(["\"", " "])
        if kind == 10:
            return prose(), word(4, 8) + str(r.randint(0, 99)), r.choice([" ", ", "]) + word()
        return prose() + r.choice(others) + glue(), word(2, 3) + "-" + ".".join(str(r.randint(0, 99)) for _ in range(3)) + "-" + word(1, 2), " " + word()

    out = []
    for k in range(rows):
        left, c, right = (secret if k % 2 else other)()
        out.append((left[-CONTEXT:], c, right[:CONTEXT], r.choice(paths), k % 2))
    return out


def _sample(findings: DataFrame) -> DataFrame:
    """At most FINDINGS rows by a seeded hash, whatever their order: half for each label, or more where the other has fewer."""
    columns = ("left", "candidate", "right", "path", "label")
    count = {r["label"]: r["count"] for r in findings.groupBy(F.col("label").cast("int").alias("label")).count().collect()}
    quota = {y: max(FINDINGS // 2, FINDINGS - count.get(1 - y, 0)) for y in (0, 1)}
    drawn = [findings.filter(F.col("label").cast("int") == y).select(*columns).orderBy(F.xxhash64(F.lit(SEED), *columns), *columns).limit(n) for y, n in quota.items()]
    return drawn[0].unionByName(drawn[1])


def forest(spark: SparkSession, findings: DataFrame | None = None) -> list[tuple]:
    """Fitted trees as nested (feature, threshold, left, right) with 0.0 or 1.0 as leaves.

    `findings` has columns left, candidate, right, path and label; at most FINDINGS of them are fitted.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    if findings is None:
        findings = spark.createDataFrame(labelled_findings(), "left string, candidate string, right string, path string, label int")
    else:
        findings = _sample(findings)
    rows = findings.coalesce(1).select(_features(F.col("candidate"), F.col("left"), F.col("right"), F.col("path")).alias("f"), F.col("label").cast("double").alias("label")).select("f.*", "label")
    fitted = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="x").fit(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows))
    return [_tree(t.toDebugString.splitlines()[1:]) for t in fitted.trees]


def _tree(lines: list[str]):
    """A tree from its printed form: `If (feature k <= t)`, its branch, `Else (...)`, its branch, or `Predict: v`."""
    at = 0

    def node():
        nonlocal at
        line = lines[at].strip()
        at += 1
        if found := re.match(r"Predict: (\S+)", line):
            return float(found[1])
        found = re.match(r"If \(feature (\d+) (?:<=|in|>) (\S+)\)", line)
        low = node()
        at += 1
        return int(found[1]), float(found[2]), low, node()

    return node()


def _vote(tree, f: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    k, threshold, low, high = tree
    return F.when(f.getField(FEATURES[k]) <= threshold, _vote(low, f)).otherwise(_vote(high, f))


def judged(docs: DataFrame, trees: list[tuple], path: str | None = "source") -> DataFrame:
    """docs with `_pieces` (the text between candidates), `_matches` (candidates) and `_found` (array of candidate, score).

    Null and empty texts have one empty piece and no candidate; repeated rows are judged alike; an empty
    table stays empty; texts are read whole, whatever their length; columns of docs so named give way.
    """
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path and path in docs.columns else F.lit("")
    text = F.coalesce("text", F.lit(""))
    # The expression runs once over a text: candidates are set between marks, and the text is cut at these.
    # Marks that a text holds already are written otherwise meanwhile.
    has_mark = text.contains(MARK)
    unmarked = F.when(has_mark, F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + IS_ESCAPE)), F.lit(MARK), F.lit(ESCAPE + IS_MARK))).otherwise(text)
    back = lambda x: F.replace(F.replace(x, F.lit(ESCAPE + IS_MARK), F.lit(MARK)), F.lit(ESCAPE + IS_ESCAPE), F.lit(ESCAPE))
    split = F.split(F.regexp_replace(unmarked, CANDIDATE, f"$1$3{MARK}$2$4$5{MARK}"), MARK, -1)
    carry = [c for c in docs.columns if c not in ("_parts", "_pieces", "_matches", "_found")]
    cut = docs.select(*[named(c) for c in carry], split.alias("_split"), has_mark.alias("_has_mark"))
    cut = cut.select(*[named(c) for c in carry], F.when(F.col("_has_mark"), F.transform("_split", back)).otherwise(F.col("_split")).alias("_parts"))
    cut = cut.withColumn("_pieces", F.filter("_parts", lambda _, k: k % 2 == 0)).withColumn("_matches", F.filter("_parts", lambda _, k: k % 2 == 1)).drop("_parts")
    # The texts before and after come as arrays: taken by index inside the function, the text would be split anew for each candidate.
    # White space of any length between a name and its value counts as a space.
    n = F.size("_matches")
    near = lambda p: F.when(F.right(p, F.lit(CONTEXT)).rlike(r"\s{3}"), F.right(F.regexp_replace(p, r"\s{2,}+", " "), F.lit(CONTEXT))).otherwise(F.right(p, F.lit(CONTEXT)))
    before = F.zip_with("_matches", F.slice("_pieces", F.lit(1), n), lambda m, p: F.struct(m.alias("m"), near(p).alias("left")))
    around = F.zip_with(before, F.slice("_pieces", F.lit(2), n), lambda x, p: F.struct(x["m"].alias("candidate"), _features(x["m"], x["left"], F.left(p, F.lit(CONTEXT)), where).alias("f")))
    described = cut.withColumn("_described", around)
    votes = lambda f: sum((_vote(t, f) for t in trees), F.lit(0.0)) / len(trees)
    return described.withColumn("_found", F.transform("_described", lambda d: F.struct(d["candidate"].alias("candidate"), votes(d["f"]).alias("score")))).drop("_described")


def scan(docs: DataFrame, trees: list[tuple], path: str | None = "source") -> DataFrame:
    """(doc_id, start, length, kind, secret_sha256, score): a row for each secret found.

    `start` counts characters from 0. Null and empty texts have none; each of several equal rows
    reports its own; an empty table gives none; `path` may be missing or null.
    """
    scored = judged(docs.select(*[c for c in ("doc_id", "text", path) if c in docs.columns]), trees, path)
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    lengths = F.zip_with(F.slice("_pieces", F.lit(1), F.size("_matches")), "_matches", lambda p, m: F.struct(F.length(p).alias("skip"), F.length(m).alias("size")))

    def step(done, m):
        here = done["at"] + m["skip"]
        return F.struct((here + m["size"]).cast("long").alias("at"), F.array_append(done["starts"], here.cast("long")).alias("starts"))

    starts = F.aggregate(lengths, first, step, lambda done: done["starts"])
    # `_found` stands once in the plan, so that candidates are judged once: a filter of rows, or the one
    # that an inner explode implies, would be pushed below and judge them again.
    hits = F.filter(F.zip_with("_found", starts, lambda f, start: F.struct(f.alias("f"), start.alias("start"))), lambda z: z["f"]["score"] >= 0.5)
    rows = scored.select("doc_id", F.explode_outer(hits).alias("z"))
    c = F.col("z.f.candidate")
    kind = F.when(c.rlike(f"^(?:{ISSUED})"), "issued").when(c.rlike("^[0-9a-fA-F]+$"), "hex").otherwise("mixed")
    return rows.filter(F.col("z").isNotNull()).select("doc_id", F.col("z.start").alias("start"), F.length(c).cast("long").alias("length"), kind.alias("kind"), F.sha2(c, 256).alias("secret_sha256"), F.round("z.f.score", 6).alias("score"))


def redact(docs: DataFrame, trees: list[tuple], path: str | None = "source") -> DataFrame:
    """docs with each secret in the text replaced by MASK, and n_chars (if there) counted anew.

    Null texts stay null and empty ones empty; each of several equal rows is masked; an empty table
    stays empty; the other columns ride along, whatever their names.
    """
    where = [F.col(path).cast("string").alias("_path")] if path and path in docs.columns else []
    packed = docs.select("text", *where, F.struct(*[named(c) for c in docs.columns]).alias("_row"))
    scored = judged(packed, trees, "_path")
    masked = F.concat(F.transform("_found", lambda f: F.when(f["score"] >= 0.5, F.lit(MASK)).otherwise(f["candidate"])), F.array(F.lit("")))
    text = F.when(F.col("text").isNotNull(), F.array_join(F.zip_with("_pieces", masked, lambda p, m: F.concat(p, m)), ""))
    out = scored.select("_row", text.alias("_text"))
    made = {"text": F.col("_text"), "n_chars": F.length("_text")}
    return out.select(*[made[c].cast(docs.schema[c].dataType).alias(c) if c in made else F.col("_row").getField(c).alias(c) for c in docs.columns])
