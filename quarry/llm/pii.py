"""Surrogates for personal data (DataFrame and SQL functions only).

Entities (email addresses, phone and card numbers, IPv4 addresses, IBANs, social
security numbers, secrets such as tokens and keys, persons' names) are found by
one regular expression over whole texts and replaced by surrogates.  A mention
has one part or two: an address has a mailbox and a domain, a person a given
name and a surname.  Every part has one surrogate in the whole corpus, however
it is written, so "Frau Anna Schmidt" and "Frau Schmidt" keep their surname in
common and two mailboxes their domain.  Surrogates are

* keyed: a function of a secret key, the kind of the part and its canonical form
  (case, separators and titles aside);
* of the same kind and format: lengths, separators, case and script of letters
  stay; a card number keeps its first digit and whether its check digit holds;
  a private address stays private; a given name keeps gender and script (names
  of the list below change places by a keyed rotation, others are made up);
  titles and top-level domains stay;
* distinct: all parts of the corpus are checked together, and one whose surrogate
  another part has, or which is some part of the corpus itself, is derived anew
  with the next attempt.  From attempt ``WIDEN`` on a surrogate may be longer by
  a character an attempt (an address leaves its private range), so that a format
  with too few values (26 mailboxes of one letter at one domain) never ends the job.

The expression has no group that repeats without bound (Java's matcher would
recurse for each repeat), and no entity begins inside a word or a run of mailbox
characters, so a text of any length is searched in linear time.

Only documents with entities are joined with surrogates; others pass untouched
and are not shuffled.  The table of distinct parts is written to the shared
folder; frequent ones are aggregated before they are shuffled.  The key travels
as a table of a row a kind, not in the text of a plan.

Cases: a null text stays null, with 0 entities; empty, very long and repeated
rows and null doc_ids are handled like any (documents are told apart by doc_id
and a hash of the text); an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from .cluster import materialise, table

#: Where the registered query finds its key; the example key is for tests and public data only.
KEY_SETTING, EXAMPLE_KEY = "spark.quarry.pii.key", "quarry-example-key"
MAX_ATTEMPTS = 40
WIDEN = 5

# Given names by gender and script, syllables for surnames by script
NAMES = {
    "latin": {
        "f": "Anna Maria Laura Julia Sophie Emma Clara Marie Elena Paula Sarah Emily Olivia Alice Hannah Camille Lucia Carmen".split(),
        "m": "John Peter Paul David Thomas Martin Lukas Felix Pierre Louis Carlos Miguel James Robert William Michael Daniel Oliver".split(),
    },
    "cyrillic": {"f": "Анна Мария Ольга Елена Ирина Наталья Татьяна Светлана".split(), "m": "Иван Пётр Алексей Дмитрий Сергей Николай Михаил Андрей".split()},
    "greek": {"f": "Μαρία Ελένη Σοφία Άννα Κατερίνα Ιωάννα".split(), "m": "Γιώργος Νίκος Δημήτρης Κώστας Παύλος Ανδρέας".split()},
}
SYLLABLES = {
    "latin": "bar ben cor dal den fer gan hol kel lan mar mon nor pel ros san tal ver wen zim".split(),
    "cyrillic": "бар бел вол гор дан жил зор кал лес мар нов пол ром сев тар фом".split(),
    "greek": "βασ γεω δημ θεο καλ λαμ μαν νικ παπ ραλ σταυ τσα".split(),
}
FEMALE_END = {"latin": "a", "cyrillic": "а", "greek": "α"}
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Mme Señora Sra".split()
MALE_TITLES = "Mr Herr Monsieur Señor Sr".split()
_TITLES = "|".join(FEMALE_TITLES + MALE_TITLES)

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_START = r"(?<![\p{L}\p{N}])"  # no entity begins inside a word; also what makes the search fast
_MAILBOX = r"[\p{L}\p{N}._%+-]"
# a domain has 127 labels of 63 characters at most
EMAIL = rf"(?<!{_MAILBOX}){_MAILBOX}++@[A-Za-z0-9-]{{1,63}}+(?:\.[A-Za-z0-9-]{{1,63}}+){{0,125}}\.[A-Za-z]{{2,63}}+"
SECRET = r"(?<=[\"'])(?<=(?i:token|secret|passwd|password|key)\s{0,3}[=:]\s{0,3}[\"'])[^\"'\s]{8,}+|(?:[0-9a-f]{32,}+|AKIA[0-9A-Z]{16}+|sk-[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])"
IPV4 = rf"(?<!\.){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)"
SSN = r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"\d(?:[ -]?\d){12,18}(?!\d)"
PHONE = r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
#: A capitalised name to its end: capitals inside (McDonald), apostrophes (O'Brien) and up to three further parts after hyphens
_WORD = r"\p{Lu}(?:\p{Ll}\p{L}*+|['’]\p{Lu}\p{L}++)(?:[-'’]\p{Lu}\p{L}*+){0,3}"
_GIVEN = "|".join(n for by in NAMES.values() for names in by.values() for n in names)
PERSON = rf"(?=\p{{Lu}})(?:(?:{_TITLES})\b\.? {_WORD}(?: {_WORD})?|(?:{_GIVEN}) {_WORD})"
_NUMERIC = f"(?=[0-9+(])(?:{IPV4}|{SSN}|{CARD}|{PHONE})"
#: In this order where several match at one place.
PATTERN = f"{_START}(?:{EMAIL}|{SECRET}|(?=[A-Z]){IBAN}|{_NUMERIC}|{PERSON})"

#: Kinds of parts
KINDS = "mailbox domain ipv4 ssn iban card phone secret given_f given_m surname".split()


def kind_of(x: Column) -> Column:
    """Kind of a mention."""
    whole = lambda p: x.rlike(rf"\A(?:{p})\z")
    digits = F.char_length(F.regexp_replace(x, r"\D", ""))
    return (
        F.when(whole(EMAIL), "email").when(whole("[0-9a-f]{32,}+"), "secret").when(whole(_OCTET + rf"(?:\.{_OCTET}){{3}}"), "ipv4").when(whole(r"\d{3}-\d{2}-\d{4}"), "ssn")
        .when(whole(r"[A-Z]{2}\d{2}[A-Z0-9 ]{8,}"), "iban").when(whole(r"\d[\d -]+") & digits.between(13, 19), "card").when(whole(r"\+?[\d(][\d ().-]+"), "phone")
        .when(whole(PERSON), "person").otherwise("secret")
    )


def parts_of(kind: Column, x: Column) -> Column:
    """array<struct<kind, canon>> of a mention: what has a surrogate of its own, in order."""
    one = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"))
    name = F.regexp_replace(x, rf"\A(?:{_TITLES})\b\.? ", "")
    given_f = "|".join(n for by in NAMES.values() for n in by["f"])
    female = x.rlike(rf"\A(?:{'|'.join(FEMALE_TITLES)})\b") | (~x.rlike(rf"\A(?:{_TITLES})\b") & name.rlike(rf"\A(?:{given_f}) "))
    surname = one(F.lit("surname"), F.lower(F.substring_index(name, " ", -1)))
    given = one(F.when(female, "given_f").otherwise("given_m"), F.lower(F.substring_index(name, " ", 1)))
    domain = one(F.lit("domain"), F.lower(F.substring_index(x, "@", -1)))
    return (
        F.when(kind == "email", F.array(one(F.lit("mailbox"), F.lower(x)), domain)).when(kind == "person", F.when(name.contains(" "), F.array(given, surname)).otherwise(F.array(surname)))
        .when(kind.isin("ipv4", "secret"), F.array(one(kind, x))).otherwise(F.array(one(kind, F.upper(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")))))
    )


def _byte(stream: str, i: str) -> str:
    return f"cast(conv(substring({stream}, 2 * ({i}) + 1, 2), 16, 10) as int)"


def _shape(text: str, seed: str, keep_first: str = "false", hexed: str = "false") -> str:
    """SQL: text with each letter and digit replaced by one of its class, in pieces of 32 with a digest each."""
    b = _byte("x.h", "i")
    pick = lambda letters: f"substring('{letters}', {b} % {len(letters)} + 1, 1)"
    latin, cyrillic, greek = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
    pieces = f"transform(regexp_extract_all({text}, '(?s).{{1,32}}', 0), (p, k) -> named_struct('p', p, 'k', k, 'h', sha2(concat({seed}, ':', cast(k as string)), 256)))"
    return f"""array_join(transform({pieces}, x -> array_join(transform(split(x.p, ''), (c, i) -> case
      when x.k = 0 and i = 0 and {keep_first} then c
      when c rlike '[0-9a-f]' and {hexed} then {pick('0123456789abcdef')}
      when c rlike '[1-9]' and x.k = 0 and i = 0 then {pick('123456789')}
      when c rlike '\\\\d' then {pick('0123456789')}
      when c rlike '[\\u0400-\\u04FF]' then if(c = upper(c), {pick(cyrillic.upper())}, {pick(cyrillic)})
      when c rlike '[\\u0370-\\u03FF]' then if(c = upper(c), {pick(greek.upper())}, {pick(greek)})
      when c rlike '\\\\p{{L}}' then if(c = upper(c) and c <> lower(c), {pick(latin.upper())}, {pick(latin)})
      else c end), '')), '')"""


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum modulo 10."""
    d = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (a, i) -> a + if(i % 2 = 0, {d}, if({d} > 4, 2 * {d} - 9, 2 * {d}))) % 10"


def _address() -> str:
    """SQL: an IPv4 address, private in the same range if the original is (until attempts widen it)."""
    o = [_byte("hexes", str(k)) for k in range(4)]
    last = f"1 + {o[3]} % 254"
    return f"""case when attempt < {WIDEN} and canon like '192.168.%' then concat('192.168.', {o[2]}, '.', {last})
      when attempt < {WIDEN} and canon rlike '^172[.](1[6-9]|2[0-9]|3[01])[.]' then concat('172.', 16 + {o[1]} % 16, '.', {o[2]}, '.', {last})
      when canon rlike '^(10[.]|192[.]168[.]|172[.](1[6-9]|2[0-9]|3[01])[.])' and attempt < {2 * WIDEN} then concat('10.', {o[1]}, '.', {o[2]}, '.', {last})
      else concat(element_at(array_except(sequence(1, 223), array(10, 127, 172, 192)), 1 + {o[0]} % 219), '.', {o[1]}, '.', {o[2]}, '.', {last}) end"""


def _name(script: str, female: str = "") -> str:
    """SQL: a made-up name of syllables, longer with each attempt."""
    items = ", ".join(f"'{s}'" for s in SYLLABLES[script])
    return f"concat(array_join(transform(sequence(1, 2 + least(attempt, 20)), k -> element_at(array({items}), {_byte('hexes', 'k')} % {len(SYLLABLES[script])} + 1)), ''), '{female}')"


def _given(gender: str) -> str:
    """SQL: another name of the list, by a keyed rotation, or a made-up one for a name that is on no list."""
    out, turn = "", "cast(conv(substring(sha2(concat(secret, '|turn'), 256), 1, 6), 16, 10) as int)"
    for script, by in NAMES.items():
        names = "array(" + ", ".join(f"'{n.lower()}'" for n in by[gender]) + ")"
        n = len(by[gender])
        at = f"array_position({names}, canon)"
        out += f" when {at} > 0 then element_at({names}, cast((({at} - 1) + 1 + {turn} % {n - 1}) % {n} + 1 as int))"
    for script in NAMES:
        if script != "latin":
            out += f" when script = '{script}' then {_name(script, FEMALE_END[script] if gender == 'f' else '')}"
    return f"case{out} else {_name('latin', FEMALE_END['latin'] if gender == 'f' else '')} end"


def with_surrogate(parts: DataFrame, key: str) -> DataFrame:
    """parts (kind, canon, attempt) with column surrogate, in the form of canon (a mailbox without its domain)."""
    keys = parts.sparkSession.createDataFrame([(k, key) for k in KINDS], "of string, secret string")
    df = parts.join(F.broadcast(keys), F.col("kind") == F.col("of")).drop("of")  # a row a kind
    df = df.withColumn("seed", F.expr("concat(secret, '|', kind, '|', canon, '|', cast(attempt as string))"))
    df = df.withColumn("hexes", F.sha2("seed", 256)).withColumn("hexed", F.expr("kind = 'secret' and canon rlike '\\\\A[0-9a-f]+\\\\z'"))
    more = f"greatest(attempt - {WIDEN - 1}, 0)"
    df = df.withColumn("own", F.expr(f"""case kind when 'mailbox' then concat(substring_index(canon, '@', 1), repeat('x', {more}))
        when 'domain' then concat(left(canon, length(canon) - length(substring_index(canon, '.', -1)) - 1), repeat('x', {more}))
        else concat(canon, repeat(if(hexed, 'a', '1'), {more})) end"""))
    df = df.withColumn("plain", F.expr(_shape("own", "hexes", "kind in ('card', 'phone')", "hexed")))
    body = "left(plain, length(plain) - 1)"
    # the last digit makes the sum what the original's is, so that validity stays
    last = f"((({_luhn('canon')}) - ({_luhn(f"concat({body}, '0')")})) % 10 + 10) % 10"
    df = df.withColumn("script", F.expr("case when canon rlike '[\\u0400-\\u04FF]' then 'cyrillic' when canon rlike '[\\u0370-\\u03FF]' then 'greek' else 'latin' end"))
    surname = "case script " + " ".join(f"when '{s}' then {_name(s)}" for s in NAMES) + " end"
    chosen = F.expr(f"""case kind when 'ipv4' then {_address()} when 'card' then concat({body}, cast({last} as string)) when 'surname' then {surname}
        when 'given_f' then {_given('f')} when 'given_m' then {_given('m')} when 'domain' then concat(plain, '.', substring_index(canon, '.', -1)) else plain end""")
    return df.select("kind", "canon", "attempt", chosen.alias("surrogate"))


def _claim() -> Column:
    """What no two parts of a kind may share: mailboxes are told apart within their domain."""
    return F.when(F.col("kind") == "mailbox", F.concat("surrogate", F.lit("@"), F.substring_index("canon", "@", -1))).otherwise(F.col("surrogate"))


def assign(parts: DataFrame, key: str = EXAMPLE_KEY) -> DataFrame:
    """(kind, canon, surrogate) for distinct parts (kind, canon), all surrogates distinct and no part of the corpus.

    Listed given names stay among themselves, so they may be names of the corpus;
    a mailbox is new if its domain is, so only its own form is ruled out.
    """
    parts = materialise(parts.select("kind", "canon"))
    taken = parts.where(~F.col("kind").startswith("given")).select("kind", F.col("canon").alias("claim"), F.col("canon").alias("by"))
    fixed: DataFrame | None = None
    left = parts.withColumn("attempt", F.lit(0))
    for _ in range(MAX_ATTEMPTS):
        tried = with_surrogate(left, key).withColumn("claim", _claim())
        first = F.row_number().over(Win.partitionBy("kind", "claim").orderBy("canon"))
        busy = taken.groupBy("kind", "claim").agg(F.max("by").alias("by"), F.count("*").alias("holders"))
        ok = tried.withColumn("turn", first).join(busy, ["kind", "claim"], "left")
        # a mailbox may have the form of another mailbox at its domain, whose surrogate domain is new
        free = F.col("by").isNull() | ((F.col("kind") == "mailbox") & (F.col("by") != F.col("canon")) & (F.col("by") == F.col("claim")) & (F.col("holders") == 1))
        ok = materialise(ok.withColumn("fine", (F.col("turn") == 1) & free).select("kind", "canon", "attempt", "surrogate", "claim", "fine"))
        good = ok.where("fine")
        fixed = good.select("kind", "canon", "surrogate") if fixed is None else fixed.unionByName(good.select("kind", "canon", "surrogate"))
        taken = taken.unionByName(good.select("kind", "claim", F.lit("").alias("by")))
        left = ok.where("not fine").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if left.isEmpty():
            return fixed
    raise RuntimeError("no distinct surrogates found: more addresses than IPv4 has")


def laid_over(kind: Column, mention: Column, new: Column) -> Column:
    """The parts' surrogates (array new) in the form of this mention: its separators, case and title."""
    title = F.regexp_extract(mention, rf"\A(?:{_TITLES})\b\.? ", 0)
    # letters and digits of the mention take those of the surrogate in turn; what is left of it follows
    spread = F.expr(r"""concat(array_join(transform(split(mention, ''), (c, i) ->
        if(c rlike '[\\p{L}\\p{N}]', substring(new[0], length(regexp_replace(left(mention, i), '[^\\p{L}\\p{N}]', '')) + 1, 1), c)), ''),
        substring(new[0], length(regexp_replace(mention, '[^\\p{L}\\p{N}]', '')) + 1))""")
    cased = lambda old, own: f"array_join(zip_with(split({old}, ''), split({own}, ''), (c, s) -> if(c is not null and c <> lower(c), upper(s), s)), '')"
    mail = F.expr(f"""concat({cased("substring_index(mention, '@', 1)", "new[0]")}, '@', {cased("substring_index(mention, '@', -1)", "new[1]")})""")
    return (
        F.when(kind == "email", mail).when(kind.isin("ipv4", "secret"), new[0]).when(kind == "person", F.concat(title, F.initcap(F.array_join(new, " "))))
        .otherwise(spread)
    )


def scrub(docs: DataFrame, key: str = EXAMPLE_KEY) -> DataFrame:
    """doc_id, text with surrogates, n_entities and kinds of every row."""
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pattern = F.lit(PATTERN)
    hit = F.col("text").rlike(PATTERN)
    held = materialise(base.where(hit).withColumn("hash", F.xxhash64("text")))  # documents with entities
    found = held.select("doc_id", F.col("hash").alias("text_hash"), F.posexplode(F.regexp_extract_all("text", pattern, F.lit(0))).alias("place", "mention")).distinct()
    mentions = materialise(found.withColumn("kind", kind_of(F.col("mention"))).withColumn("parts", parts_of(F.col("kind"), F.col("mention"))))
    forms = mentions.groupBy("mention").agg(F.any_value("kind").alias("of"), F.any_value("parts").alias("parts"))
    parts = forms.select("mention", "of", F.posexplode("parts").alias("nth", "part")).select("mention", "of", "nth", "part.kind", "part.canon")
    named = parts.join(assign(parts.select("kind", "canon").distinct(), key), ["kind", "canon"])
    new = named.groupBy("mention", "of").agg(F.array_sort(F.collect_list(F.struct("nth", "surrogate"))).alias("news")).withColumn("new", F.transform("news", lambda x: x["surrogate"]))
    replaced = new.select("mention", laid_over(F.col("of"), F.col("mention"), F.col("new")).alias("new"))
    per_doc = mentions.join(replaced, "mention").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("place", "new"))).alias("news"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    per_doc = per_doc.withColumnRenamed("doc_id", "id")
    touched = held.join(per_doc, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash")))
    gaps = F.split("text", PATTERN, -1)
    text = F.array_join(F.zip_with(gaps, F.transform("news", lambda n: n["new"]), lambda gap, n: F.concat(gap, F.coalesce(n, F.lit("")))), "")
    done = touched.select("doc_id", text.alias("text"), F.size("news").cast("long").alias("n_entities"), "kinds")
    clean = base.where(~F.coalesce(hit, F.lit(False))).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    return clean.unionByName(done)


def query(spark, sf_dir: str) -> DataFrame:
    return scrub(table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, EXAMPLE_KEY))
