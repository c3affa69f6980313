"""PII surrogates: detected entities get keyed replacements of their own kind. DataFrame and SQL functions only.

An entity is a kind and a normal form (an e-mail address in lower case, the digits of a number, one word of a name), so every mention
of it, in any document and any notation, gets one replacement. A name is found by a title or phrase before it; then each of its words is
one wherever it stands in that document. Whether a word is a given name or a surname, and its gender, is told by all its mentions
together. Replacements are drawn from a keyed hash and then checked: two entities never share one, and none equals an entity that occurs;
those that clash draw again until no clash is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_kept, keep, spare, table

#: Titles and phrases before a name, by the gender that they tell.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Господин", "господин", "Κύριος", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа", "госпожа", "Κυρία", "κυρία")
TITLES = ("Dr", "Prof", "Professor", "Доктор", "доктор")
PHRASES = ("[Mm]y name is", "[Ii]ch heiße", "[Jj]e m'appelle", "[Mm]e llamo", "[Мм]еня зовут", "[Μμ]ε λένε")
#: Before a name of two words or more only.
OPENINGS = ("Dear", "Contact:", "Name:", "Attn:")
#: Given names by script and gender.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl Daniel Emil Felix Gabriel Hugo Ivan Jonas Karl Lucas Martin Noel Oscar Paul Rafael Simon Thomas Victor",
    ("latin", "f"): "Alice Berta Clara Diana Emma Flora Greta Helena Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sara Teresa Vera",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Тимур Фёдор Юрий",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Инна Ксения Лидия Мария Нина Ольга Полина Раиса София Тамара Юлия",
    ("greek", "m"): "Αλέξανδρος Γιάννης Δημήτρης Ηλίας Θωμάς Κώστας Λουκάς Μάρκος Νίκος Παύλος Στέφανος Φίλιππος",
    ("greek", "f"): "Αγγελική Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ηρώ Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα",
}
#: Surnames, and given names of no known gender, are built of these syllables, so there is no end of them.
ONSETS = {"latin": "b d f g h k l m n p r s t v w", "cyrillic": "б в г д ж з к л м н п р с т ф", "greek": "β γ δ θ κ λ μ ν π ρ σ τ φ χ"}
VOWELS = {"latin": "a e i o u", "cyrillic": "а е и о у", "greek": "α ε η ι ο"}
ENDINGS = {
    ("surname", "latin"): {"m": "n", "f": "n", "n": "n"}, ("surname", "cyrillic"): {"m": "ров", "f": "рова", "n": "ко"}, ("surname", "greek"): {"m": "ς", "f": "υ", "n": "ου"},
    ("given", "latin"): {"n": "ri"}, ("given", "cyrillic"): {"n": "ша"}, ("given", "greek"): {"n": "ι"},
}
#: Letters that stand for those of a script; names of the scripts without capitals are drawn from them.
LETTERS = {
    "latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "han": "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗伟芳娜敏静强磊军洋勇艳杰涛明超", "hangul": "김이박최정강조윤장임한오서신권황안송전홍민지수현영",
    "kana": "あいうえおかきくけこさしすせそたちつてとなにぬねの", "arabic": "ابتجحخدرزسشصطعغفقكلمنهوي", "hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "devanagari": "कखगचजटडतदनपबमयरलवशसह",
}
#: The class of each script's letters; what is in none counts as the first.
CLASSES = {"latin": "L", "cyrillic": "IsCyrillic", "greek": "IsGreek", "han": "IsHan", "hangul": "IsHangul", "kana": "IsHiragana", "arabic": "IsArabic", "hebrew": "IsHebrew", "devanagari": "IsDevanagari"}

_WORD = r"(?:(?:\p{Lu}[\p{Ll}'’]++(?:-\p{Lu}[\p{Ll}'’]++)?|\p{Lu}{2,}+)(?![\p{L}\p{N}])|\p{Lo}[\p{Lo}\p{M}]{0,19}+(?![\p{L}\p{N}]))"
_BEFORE = rf"(?:(?:{'|'.join(MALE + FEMALE + TITLES)})\.?|{'|'.join(PHRASES)}|(?:{'|'.join(OPENINGS)})(?= {_WORD} {_WORD}))"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,8}+",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])",
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30}+)(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}_])(?<![0-9][.,-])(?:(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|(?:\+?1[ .-])?[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}|0[0-9]{2,4} [0-9]{3,4} [0-9]{3,4}|(?<=(?:[Tt]el|[Pp]hone|[Cc]all|[Ff]ax|[Mm]obile|[Cc]ell)\.?:? ?)[0-9]{7,12})(?![\p{L}\p{N}]|[.,-][0-9])",
    "card": r"(?<![\p{L}\p{N}_-])(?<![0-9][.,])(?:[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{1,7}|[0-9]{13,19}+)(?![\p{L}\p{N}_]|[.,-][0-9])",
    "ssn": r"(?<![\p{L}\p{N}_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}_]|-[0-9])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_BEFORE} {_WORD}(?: {_WORD}){{0,2}}",
}
ANY = "|".join(PATTERNS.values())
#: Every match holds an @, a digit, or one of these.
STEMS = ("Mr", "Ms", "Miss", "Herr", "Frau", "Monsieur", "Madame", "Señor", "осподин", "оспожа", "ύριος", "υρία", "Dr", "Prof", "октор", "y name is", "ch heiße", "e m'appelle", "e llamo", "еня зовут", "ε λένε", "Dear ", "Contact: ", "Name: ", "Attn: ")
#: Draws after which a kind counts as exhausted.
DRAWS = 64


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _script(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} RLIKE '\\\\p{{{x}}}' THEN '{n}'" for n, x in list(CLASSES.items())[1:]) + " ELSE 'latin' END"


def _mod97(x: str) -> str:
    letters = f"array_join(transform(split({x}, ''), c -> if(c RLIKE '[A-Z]', cast(ascii(c) - 55 AS string), c)), '')"
    return f"aggregate(split({letters}, ''), 0L, (a, c) -> (a * 10 + cast(c AS bigint)) % 97)"


def scanned(docs: DataFrame, hits: str, gaps: str) -> DataFrame:
    """`docs` with the matches in each text and what stands between them, both null where there is none, as a written table.

    Texts without a character or word that all matches of a kind hold are told by plain searches. In a text with names, the names'
    words are matches too wherever they stand.
    """
    any_ = _lit(ANY)
    maybe = F.col("text").contains("@") | F.col("text").rlike("[0-9]")
    for stem in STEMS:
        maybe = maybe | F.col("text").contains(stem)
    docs = docs.withColumn(hits, F.when(maybe, F.expr(f"regexp_extract_all(text, {any_}, 0)")))
    before = _lit(f"^{_BEFORE} ")
    words = f"array_distinct(flatten(transform(filter(`{hits}`, x -> x RLIKE {before}), x -> split(regexp_replace(x, {before}, ''), ' '))))"
    docs = docs.withColumn(gaps, F.expr(f"CASE WHEN size(`{hits}`) > 0 THEN array_distinct(flatten(transform(filter({words}, x -> length(x) > 1), x -> array(x, upper(x), initcap(x))))) END"))  # for now the names' words
    own = f"concat({any_}, '|(?<![\\\\p{{L}}\\\\p{{N}}])(?:', array_join(`{gaps}`, '|'), ')(?![\\\\p{{L}}\\\\p{{N}}])')"
    docs = docs.withColumn(gaps, F.expr(f"CASE WHEN size(`{gaps}`) > 0 THEN {own} WHEN size(`{hits}`) > 0 THEN {any_} END"))  # the pattern
    docs = docs.withColumn(hits, F.expr(f"CASE WHEN length(`{gaps}`) > {len(ANY)} THEN regexp_extract_all(text, `{gaps}`, 0) WHEN size(`{hits}`) > 0 THEN `{hits}` END"))
    return keep(docs.withColumn(gaps, F.expr(f"CASE WHEN `{gaps}` IS NOT NULL THEN split(text, `{gaps}`, -1) END")), "scanned-texts")


def mentions(found: DataFrame) -> DataFrame:
    """key, pos, part, prefix, raw, kind, norm, role, script, gender: the parts of every mention of rows (key, hits); role and gender
    are what this mention tells of a name's word, or empty."""
    hits = found.select("key", F.posexplode("hits").alias("pos", "token"))
    kind = F.lit("name")
    for k in ("ssn", "card", "phone", "iban", "ip6", "ip"):
        kind = F.when(F.col("token").rlike(f"^(?:{PATTERNS[k]})$".replace("\\2", "\\1")), k).otherwise(kind)
    phone = F.col("token").rlike("^[0-9]{7,12}$")  # by what stands before it
    hits = hits.dropDuplicates(["key", "pos"]).withColumn("kind", F.when(F.col("token").contains("@"), "email").when(phone, "phone").otherwise(kind))
    hits = hits.withColumn("digits", F.regexp_replace("token", "[^0-9]", "")).withColumn("cc", F.regexp_extract("token", r"^\+([0-9]{1,3})[ .(-]", 1))
    hits = hits.withColumn("plain", F.regexp_replace("token", " ", ""))
    valid = F.expr(f"CASE kind WHEN 'card' THEN luhn_check(digits) WHEN 'iban' THEN {_mod97('concat(substr(plain, 5), substr(plain, 1, 4))')} = 1 ELSE true END")
    hits = hits.withColumn("kind", F.when(valid, F.col("kind")).otherwise("number"))
    hits = hits.withColumn("before", F.regexp_extract("token", f"^{_BEFORE.replace(f'(?= {_WORD} {_WORD})', '')} ", 0))
    hits = hits.withColumn("words", F.expr("split(substr(token, length(before) + 1), ' ')"))
    is_ = lambda which: F.col("before").rlike(f"^(?:{'|'.join(which)})[. ]")
    listed = lambda gender: F.lower(F.col("words")[0]).isin([n.lower() for (_, g), names in GIVEN.items() if g == gender for n in names.split()]) & (F.col("before") != "")
    hits = hits.withColumn("titled", is_(MALE + FEMALE + TITLES))
    hits = hits.withColumn("gender", F.when(is_(MALE), "m").when(is_(FEMALE), "f").when(listed("m"), "m").when(listed("f"), "f").otherwise(""))
    part = "named_struct('prefix', {}, 'raw', {}, 'kind', {}, 'norm', {}, 'role', {}, 'gender', {})".format
    plain = lambda norm: "array(" + part("''", "token", "kind", norm, "''", "''") + ") "
    parts = (
        "CASE kind WHEN 'email' THEN array("
        + part("''", "split_part(token, '@', 1)", "'mailbox'", "lower(token)", "''", "''") + ", "
        + part("'@'", "split_part(token, '@', 2)", "'domain'", "lower(split_part(token, '@', 2))", "''", "''") + ") "
        "WHEN 'phone' THEN " + plain("concat(cc, '|', substr(digits, length(cc) + 1))") +
        "WHEN 'ip' THEN " + plain("regexp_replace(token, '(^|\\\\.)0+(?=[0-9])', '$1')") + "WHEN 'ip6' THEN " + plain("lower(token)") + "WHEN 'iban' THEN " + plain("plain") +
        "WHEN 'name' THEN transform(words, (w, i) -> "
        + part("if(i = 0, before, ' ')", "w", "kind", "lower(w)", "CASE WHEN before = '' THEN '' WHEN size(words) > 1 THEN if(i < size(words) - 1, 'given', 'surname') WHEN titled THEN 'surname' ELSE 'given' END", "gender") + ") "
        "ELSE " + plain("digits") + "END"
    )
    return hits.select("key", "pos", F.posexplode(F.expr(parts)).alias("part", "p")).select("key", "pos", "part", "p.*")


def entities_of(found: DataFrame) -> DataFrame:
    """kind, norm, type of every entity: type is the kind, or a name's role, script and gender as most of its mentions tell them (given
    where as many tell either; no gender where as many tell either or none does)."""
    n = lambda column, x: F.count_if(F.col(column) == x)
    votes = found.filter("kind <> 'number'").groupBy("kind", "norm").agg(*(n(c, x).alias(x) for c, x in (("role", "given"), ("role", "surname"), ("gender", "m"), ("gender", "f"))))
    name = F.concat_ws(":", F.when(F.col("surname") > F.col("given"), "surname").otherwise("given"), F.expr(_script("norm")), F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n"))
    return votes.select("kind", "norm", F.when(F.col("kind") == "name", name).otherwise(F.col("kind")).alias("type"))


def _draw(secret: str) -> Column:
    """The replacement that (kind, norm, type, attempt) draws, in the form of a norm."""
    seed = f"concat_ws('/', {_lit(secret)}, kind, norm, attempt)"
    stream = f"array_join(transform(sequence(0, length(norm) DIV 32 + 1), k -> sha2(concat({_lit(secret)}, sha2(concat({seed}, '/', k), 256)), 256)), '')"
    at = lambda i, n: f"cast(conv(substr(stream, 2 * ({i}) + 1, 2), 16, 10) AS int) % {n}"
    wide = lambda i, n: f"cast(conv(substr(stream, 8 * ({i}) + 1, 8), 16, 10) AS bigint) % {n}"
    letter = lambda script, i: f"substr('{LETTERS[script]}', {at(i, len(LETTERS[script]))} + 1, 1)"
    sub = "CASE WHEN c RLIKE '[0-9]' THEN cast(" + at("i", 10) + " AS string) "
    for script in reversed(LETTERS):
        sub += f"WHEN c RLIKE '\\\\p{{{CLASSES[script]}}}' THEN {letter(script, 'i')} "
    same_classes = lambda text: f"array_join(transform(split({text}, ''), (c, i) -> {sub} ELSE c END), '')"
    more = "if(attempt < 4, '', substr(translate(stream, 'abcdef', '012345'), 1, attempt - 3))"  # short ones grow when they keep clashing
    digits = lambda text: f"array_join(transform(split({text}, ''), (c, i) -> cast({at('i', 10)} AS string)), '')"
    card = f"concat(substr(norm, 1, 1), {digits('substr(norm, 2)')})"
    account = f"upper({same_classes('substr(norm, 5)')})"
    hexes = f"array_join(transform(split(norm, ''), (c, i) -> CASE WHEN c RLIKE '[0-9]' THEN cast({at('i', 10)} AS string) WHEN c = ':' THEN c ELSE substr('abcdef', {at('i', 6)} + 1, 1) END), '')"
    out = (
        f"CASE type WHEN 'mailbox' THEN concat({same_classes('split_part(norm, chr(64), 1)')}, {more}, '@', split_part(norm, '@', 2)) "
        f"WHEN 'domain' THEN concat({same_classes("regexp_replace(norm, '\\\\.[^.]+$', '')")}, {more}, regexp_extract(norm, '\\\\.[^.]+$', 0)) "
        f"WHEN 'ip' THEN concat_ws('.', 1 + {at(0, 223)}, {at(1, 256)}, {at(2, 256)}, 1 + {at(3, 254)}) "
        f"WHEN 'ip6' THEN {hexes} "
        f"WHEN 'iban' THEN transform(array({account}), x -> concat(substr(norm, 1, 2), lpad(cast(98 - {_mod97("concat(x, substr(norm, 1, 2), '00')")} AS string), 2, '0'), x))[0] "
        f"WHEN 'phone' THEN concat(split_part(norm, '|', 1), '|', {digits("split_part(norm, '|', 2)")}) "
        f"WHEN 'card' THEN concat(substr({card}, 1, length(norm) - 1), filter(sequence(0, 9), d -> luhn_check(concat(substr({card}, 1, length(norm) - 1), d)))[0]) "
        f"WHEN 'ssn' THEN {digits('norm')} "
    )
    for (script, gender), names in GIVEN.items():
        out += f"WHEN 'given:{script}:{gender}' THEN array_join(transform(sequence(0, attempt DIV 3), k -> lower(split('{names}', ' ')[{wide('k % 8', len(names.split()))}])), '-') "
    for (role, script), endings in ENDINGS.items():
        syllable = f"concat(split('{ONSETS[script]}', ' ')[{at('2 * (k % 8)', len(ONSETS[script].split()))}], split('{VOWELS[script]}', ' ')[{at('2 * (k % 8) + 1', len(VOWELS[script].split()))}])"
        for gender, ending in endings.items():
            out += f"WHEN '{role}:{script}:{gender}' THEN concat(array_join(transform(sequence(0, 2 + attempt DIV 2), k -> {syllable}), ''), '{ending}') "
    for script in list(LETTERS)[3:]:  # in scripts without capitals as many letters as there were, and more if they keep clashing
        for which in (f"{role}:{script}:{gender}" for role in ("given", "surname") for gender in "mfn"):
            out += f"WHEN '{which}' THEN array_join(transform(sequence(1, length(norm) + attempt DIV 4), i -> {letter(script, 'i % 30')}), '') "
    return F.expr(f"transform(array({stream}), stream -> {out} END)[0]")


def surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """kind, norm, core for distinct (kind, norm, type): a keyed replacement each, none of which equals another or any norm of its kind.

    Of those that clash the one with the fewest attempts and then the smallest norm stays; the others draw again. A round shuffles
    entities only; the first one settles nearly all. Raises after DRAWS rounds, when a kind has hardly a free replacement of its format
    left (as with nearly all social security numbers there are): a shared one would be worse.
    """
    state = keep(entities.withColumn("attempt", F.lit(0)).withColumn("core", _draw(secret)), "surrogates")
    for attempt in range(1, DRAWS + 1):
        first = Window.partitionBy("kind", "core").orderBy("attempt", "norm")
        real = entities.select("kind", F.col("norm").alias("core"), F.lit(True).alias("real"))
        ranked = state.withColumn("nth", F.row_number().over(first)).join(real, ["kind", "core"], "left")
        ranked = keep(ranked.select("kind", "norm", "type", "attempt", "core", (F.col("real").isNotNull() | (F.col("nth") > 1)).alias("again")), "surrogates")
        drop_kept(state)
        if ranked.filter("again").isEmpty():
            return ranked.select("kind", "norm", "core")
        drawn = ranked.filter("again").withColumn("attempt", F.lit(attempt)).withColumn("core", _draw(secret))
        state = ranked.filter("NOT again").union(drawn).drop("again") if attempt % 8 else keep(ranked.filter("NOT again").union(drawn).drop("again"), "surrogates")
    raise ValueError(f"no free replacements are left after {DRAWS} draws: {[r['kind'] for r in ranked.filter('again').select('kind').distinct().collect()]}")


def pseudonymise(docs: DataFrame, secret: str) -> DataFrame:
    """`docs` with every detected entity of `text` replaced, and n_entities, how many mentions that were.

    Kinds: e-mail addresses (mailbox and domain for themselves; the top domain stays), IPv4 and IPv6 addresses, IBANs with valid check
    digits (country, grouping and validity stay), phone numbers (country code and notation stay), card numbers with a valid check digit
    (first digit and grouping stay, and the new check digit is valid), social security numbers, and names after a title or phrase, with
    all further mentions of their words in the document (each word by itself, in its script, by role and gender, neutral where no
    gender is told; the title stays). Capitals and separators are kept, and the lengths of all but names and of entities whose first
    draws clash. Each whole text is scanned once, and the texts with their matches are a written table; only texts with a match are
    shuffled, once, by a join on a digest of the text that adaptive execution can split; mentions of copies of a text are looked up once.
    Null texts stay null with 0 entities, empty ones empty. Other columns and repeated rows stay; a column n_entities of the input is
    replaced.
    """
    docs = docs.drop("n_entities")
    hits, gaps, key, new, count = (spare(docs, x) for x in ("_hits", "_gaps", "_key", "_new", "_count"))
    rows = scanned(docs, hits, gaps)
    dirty = rows.filter(F.col(hits).isNotNull()).withColumn(key, F.md5("text"))
    found = keep(mentions(dirty.select(F.col(key).alias("key"), F.col(hits).alias("hits"))), "mentions")
    cores = surrogates(entities_of(found), secret)
    core = F.expr("CASE kind WHEN 'mailbox' THEN split_part(core, '@', 1) WHEN 'phone' THEN replace(core, '|', '') ELSE core END")
    word = F.expr("array_join(transform(split(core, '-'), w -> initcap(w)), '-')")
    numbered = F.expr(
        "aggregate(split(raw, ''), named_struct('out', '', 'i', 1), (a, c) -> if(c RLIKE '[0-9A-Z]', "
        "named_struct('out', concat(a.out, substr(core, a.i, 1)), 'i', a.i + 1), named_struct('out', concat(a.out, c), 'i', a.i)), a -> a.out)"
    )
    own = found.join(cores, ["kind", "norm"], "left").withColumn("core", core)
    shown = (
        F.when(F.col("kind") == "number", F.col("raw")).when(F.col("kind").isin("phone", "card", "ssn", "iban"), numbered).when(F.col("kind") == "ip", F.col("core"))
        .when((F.upper("raw") == F.col("raw")) & (F.lower("raw") != F.col("raw")) & (F.length("raw") > 1), F.upper("core"))
        .when(F.col("kind").isin("mailbox", "domain", "ip6"), F.col("core")).otherwise(word)
    )
    own = own.select("key", "pos", "part", F.concat("prefix", shown).alias("s"), (F.col("kind") != "number").cast("int").alias("n"))
    own = own.groupBy("key", "pos").agg(F.array_join(F.array_sort(F.collect_list(F.struct("part", "s")))["s"], "").alias("s"), F.max("n").alias("n"))
    own = own.groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_list(F.struct("pos", "s")))["s"].alias(new), F.sum("n").cast("int").alias(count))
    clean = rows.filter(F.col(hits).isNull()).drop(hits, gaps).withColumn("n_entities", F.lit(0))
    rebuilt = F.expr(f"array_join(zip_with(`{gaps}`, `{new}`, (a, b) -> concat(a, coalesce(b, ''))), '')")
    changed = dirty.join(own, key).withColumn("text", rebuilt).withColumn("n_entities", F.col(count))
    return clean.unionByName(changed.select(*clean.columns))


#: The key of the registered query and the pipeline; a real run passes a secret of its own.
KEY = "quillspark demonstration key"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), KEY).select("doc_id", "text", "n_entities")


QUERIES = {"op5_pii": op5_pii}
ORACLE: dict[str, str] = {}
