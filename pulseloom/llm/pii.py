"""Personal data by weak supervision.

Regex, gazetteer, context and form labelers vote (1 personal, -1 not, 0 no opinion) on candidate spans: the spans of four
exact patterns and eight looser shapes (local phones, social security numbers, IBANs, spelled-out mail addresses, names,
streets, birth dates, passports). Expectation-maximisation over the counts of vote patterns, for each kind by itself, estimates how
reliable each labeler is; its probabilities then train the final span classifier, a naive Bayes over features of a candidate that no
labeler votes by: kind, size, neighbouring characters, the word before. A candidate is added to the spans of the exact patterns,
which always stay, if the classifier's odds and those of its votes accept it together, the labelers are for it both by number and by
their reliabilities, and neither a check nor the context is against it. Names are found by their shape, listed or not, and need a context that speaks of a person and not of a work.

Texts are read once with built-in expressions; what is found goes to a settled table. The driver sees only the counts of
vote and feature patterns, at most 3^4 x 12 x 3 x 4 x 4 x (CUES + 2) rows at any input size.

Spans count code points, end exclusive. Defined results: a text is read whole, however long; of matches of one pattern the leftmost
counts, and added spans may overlap each other; a null or empty text has no spans; where no candidates exist the
classifier adds nothing; repeated rows give repeated results; an empty table gives none; other columns of the input are
not looked at. Patterns are possessive or anchored at the start of a run, so that a run of any length costs linear time
and no recursion.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.common import documents, settle

# Gazetteers and context words.
ENDINGS = "com|org|net|edu|gov|info|biz|io|de|fr|es|it|nl|uk|eu|us|ca|mx|ar|at|ch|be|pt"
CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|35"
BANKS = "AD|AE|AL|AT|AZ|BA|BE|BG|BH|BR|CH|CR|CY|CZ|DE|DK|DO|EE|ES|FI|FO|FR|GB|GE|GI|GL|GR|GT|HR|HU|IE|IL|IS|IT|JO|KW|KZ|LB|LI|LT|LU|LV|MC|MD|ME|MK|MR|MT|MU|NL|NO|PK|PL|PS|PT|QA|RO|RS|SA|SE|SI|SK|SM|TN|TR|UA|VG|XK"
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Sr|Sra|Señor|Señora|Monsieur|Madame|Mme"
GIVEN = (
    "Ahmed|Aisha|Alexander|Ali|Alice|Amanda|Amy|Ana|Andrea|Andrew|Anna|Anne|Anthony|Antonio|Barbara|Benjamin|Brian|Carlos|Carmen|Carol|Catherine|Charles|Charlotte|Christian|Christine|Christopher|Claire|Daniel|David|Deborah|Diego|"
    "Donald|Dorothy|Edward|Elena|Elizabeth|Emily|Emma|Eric|Fatima|Felix|Fernando|Francisco|Frank|François|George|Giulia|Hannah|Hans|Helen|Heather|Henry|Isabel|Jack|Jacob|James|Jane|Jason|Javier|Jean|Jennifer|Jessica|Joan|Johann|John|Jonathan|José|"
    "Joseph|Joshua|Juan|Julia|Karen|Karl|Katharina|Katherine|Kevin|Klaus|Laura|Lauren|Linda|Lisa|Louis|Lucas|Lucía|Luis|Manuel|Marco|Margaret|Maria|María|Marie|Mark|Martin|Mary|Matthew|Melissa|Michael|Michelle|Miguel|Mohammed|Nancy|Nicholas|Nicole|Olivia|"
    "Pablo|Patricia|Patrick|Paul|Pedro|Peter|Philip|Pierre|Rachel|Rebecca|Richard|Robert|Ronald|Ruth|Ryan|Samuel|Sandra|Sarah|Sean|Sofia|Sophie|Stefan|Stephen|Steven|Susan|Teresa|Thomas|Timothy|Ursula|Victor|Wei|William|Wolfgang|Yuki"
)
#: Capitalised words that a name doesn't start with.
NOT_FIRST = (
    "Dear|Contact|Patient|Employee|Customer|Client|Tenant|Member|My|Our|His|Her|Its|Your|Their|The|This|That|These|Those|Call|Ask|Signed|Name|Hi|Hello|From|To|Best|Kind|Warm|Regards|Sincerely|With|In|On|At|For|And|But|Or|If|When|While|Please|Mail|Email|Write|Send|Tell|"
    "Meet|See|Is|Are|Was|It|He|She|We|They|You|Yours|Attn|Attention|Speak|Novel|Painted|Directed|Written|Visit|After|Before|Ich|Mein|Der|Die|Das|Frau|Herr|Je|Le|La|Les|Mon|El|Los|Las|Mi|Soy|Von|Thanks|Passport|President|King|Queen|Saint|Mount|Lake|New|North|South|East|West"
)
MONTHS = "Jan(?:uary|uar)?|Feb(?:ruary|ruar)?|Mar(?:ch|s|zo)?|März|Apr(?:il)?|May|Mai|Mayo|June?|Juni|Juin|Junio|July?|Juli|Juillet|Julio|Aug(?:ust)?|Août|Agosto|Sept?(?:ember|embre|iembre)?|Oct(?:ober|obre|ubre)?|Okt(?:ober)?|Nov(?:ember|embre|iembre)?|Dec(?:ember)?|Dez(?:ember)?|Déc(?:embre)?|Dic(?:iembre)?|Enero|Febrero|Janvier|Février|Avril|Abril"
NO_NAMES = "Street|Avenue|Road|University|College|School|Hospital|Church|Award|Prize|Museum|Airport|Bridge|River|Lake|Island|Islands|County|City|Park|Day|Act|Theorem|Inc|Ltd|GmbH|Corporation|Foundation"
WAYS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Place|Square|Way|Terrace"
TELLS = {
    "email": "mail|contact|write|reach|address|correo|courriel",
    "ip": "server|host|address|login|from|ip",
    "card": "card|visa|credit|debit|pay|karte|tarjeta|carte",
    "phone": "phone|tel|call|fax|mobile|cell|text|anruf|handy|llam|appel",
    "local_phone": "phone|tel|call|fax|mobile|cell|text|reach|contact|anruf|handy|llam|appel",
    "social": "ssn|social|security|tax",
    "iban": "iban|bank|account|konto|cuenta|compte|transfer|pay",
    "spelled_email": "mail|contact|write|reach|correo|courriel|schreib",
    "street": "live|lives|living|address|home|ship|send|moved|resid|wohn|adresse|dirección|domicil|habit",
    "birth": "born|birth|dob|geboren|geburt|nacid|nacim|né le|née|naiss",
    "passport": "passport|reisepass|pasaporte|passeport",
}
#: What stands before or after a person's name where it is personal, and where it is not.
NAME_BEFORE = r"(?i)(?:\bname(?:\x20is|\x20was|d)?|\bi\x20am|\bi['’]m|\bsigned(?:\x20by)?|sincerely|regards|wishes|\bdear|\bhi|\bhello|\bcontact|\bemployee|\bpatient|\bcustomer|\bclient|\btenant|\bmember|\bheiße|\bich\x20bin|\bllamo|\bsoy|\bappelle|\bje\x20suis|\bask\x20for|\bspeak\x20(?:to|with)|\battn|\battention|\bmet(?:\x20with)?|\bphoned|\bemailed)[\x20:,.\n-]*$"
NAME_AFTER = r"(?i)^[\x20,]*(?:\(?(?:ssn|dob|date\x20of\x20birth|phone|tel\b|e-?mail|passport|id\x20number)|(?:was\x20)?born\x20on|lives\x20(?:at|in|on)|can\x20be\x20reached|['’]s\x20(?:phone|address|number|e-?mail|passport|ssn|birthday|home))"
NAME_AGAINST = r"(?i)(?<!signed\x20)(?:\bby|\bnovel(?:ist)?|\bpainter|\bauthor|\bpoet|\bcomposer|\bdirector|\bact(?:or|ress)|\bpresident|\bking|\bqueen|\bemperor|\bphilosopher|\bscientist|\bphysicist|\bmathematician|\bwriter|\bstarring|\bplays?|\bfilms?|\bsongs?|\balbums?|\b(?:biography|works|city|life|death|age)\x20of|\bnear|\bvisit)[\x20:,]*(?:the\x20)?$"
NAME_AGAINST_AFTER = r"(?i)^(?:['’]s\x20(?:novels?|theor|painting|symphon|plays?|poems?|laws?|films?|works?)|[\x20,]*(?:\(?1[0-9]{3}\b|wrote|composed|painted|crossed|discovered|invented|directed|founded|theorem|street|award|prize|university|museum))"
#: Before a number: what it is the number of, and words that say so only where nothing personal stands before them.
AGAINST = r"(?i)(?:(?:\bversion|\bv|\bisbn|\bissn|\bdoi|\bitem|\bpart|\bserial|\border|\binvoice|\bticket|\bmodel|\bsku|\bref|\breference|\bcase|\bbuild|\brelease|\blot|\bbatch)[\x20.:]*(?:(?:no|nr|number|code|id)\b)?[\x20.:#]*|\$|=|/)$"
AGAINST_WEAK = r"(?i)(?:\bno|\bnr|\bnumber|\bcode|#)[\x20.:]*$"
AGAINST_AFTER = r"(?i)^[\x20,]*(?:parts?|units?|items?|pcs|pieces|serial|edition|build|release|theorem|street|award)\b"
CUES = "address|appelle|born|by|call|card|case|contact|dear|dob|fax|from|home|host|iban|in|ip|is|item|invoice|live|lives|mail|mobile|name|nr|number|order|part|patient|phone|reach|ref|regards|serial|server|sincerely|ssn|tel|the|ticket|to|version|with|write".split("|")

L = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{L})|\G){L}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser shapes; the classifier decides.
LOCAL_PHONE = (
    r"(?<![0-9+])(?<![0-9][\x20-])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|\(?0[0-9]{1,4}\)?[\x20/-]{1,2}[0-9]{3,4}[\x20-]?[0-9]{3,5}|0[0-9](?:[\x20.][0-9]{2}){4}|[0-9]{3}-[0-9]{4})(?![\x20-]?[0-9])"
)
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_AT, _DOT = r"(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)", r"(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20)"
SPELLED = rf"(?i)(?<!{L}){L}{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{2,63}}+){{1,4}}"
_NAME = r"\p{Lu}[\p{L}'’-]{1,30}+"
NAME = (
    rf"(?<![\p{{L}}\p{{N}}])(?:(?:{TITLES})\.?\x20{_NAME}(?:\x20{_NAME}){{0,2}}"
    rf"|(?!(?:{NOT_FIRST})\x20){_NAME}(?:\x20(?:\p{{Lu}}\.|de|del|van|von|der|den|al|bin|da|di|la|el)){{0,2}}\x20(?!(?:{NOT_FIRST})\x20){_NAME}(?:\x20{_NAME})?)(?![\p{{L}}\p{{N}}])"
)
PASSPORT = r"(?<![A-Za-z0-9])(?:[A-Z]{1,2}[0-9]{6,8}|[0-9]{9}|[CFGHJK][0-9CFGHJKLMNPRTVWXYZ]{8})(?![A-Za-z0-9])"
STREET = (
    rf"(?<![\p{{L}}\p{{N}}])(?:[0-9]{{1,5}}[A-Za-z]?\x20(?:\p{{Lu}}[\p{{L}}'.-]{{0,30}}+\x20){{1,3}}(?:{WAYS})(?![\p{{L}}\p{{N}}])"
    r"|\p{Lu}[\p{L}-]{1,30}?(?:straße|strasse|str\.|weg|platz|allee|gasse)\x20[0-9]{1,4}[a-z]?(?![\p{L}\p{N}])"
    r"|(?:[0-9]{1,4},?\x20)?(?:[Rr]ue|[Cc]alle|[Aa]venida|[Pp]laza)\x20(?:(?:de|del|des|du|la|les)\x20){0,3}\p{Lu}[\p{L}'-]{1,30}+(?:,?\x20[0-9]{1,4})?(?![\p{L}\p{N}]))"
)
BIRTH = (
    r"(?<![\p{L}\p{N}./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./](?:(?:19|20)[0-9]{2}|[0-9]{2})"
    rf"|[0-9]{{1,2}}(?:st|nd|rd|th|er|\.)?(?:\x20de|\x20of)?\x20(?i:{MONTHS})\.?,?(?:\x20de|\x20del)?\x20(?:19|20)[0-9]{{2}}|(?i:{MONTHS})\.?\x20[0-9]{{1,2}}(?:st|nd|rd|th)?,?\x20(?:19|20)[0-9]{{2}})(?![\p{{L}}\p{{N}}/-])"
)
BASE = ("email", "ip", "card", "phone")
LOOSE = ("local_phone", "social", "iban", "spelled_email", "name", "street", "birth", "passport")
KINDS = (*BASE, *LOOSE)
NEAR = 24  # characters of context on either side
CHUNK = 128


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True where a string of digits passes the Luhn check."""
    n = F.length(number)
    worth = lambda i: F.substring(number, n - i + 1, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, worth(i)).when(worth(i) > 4, worth(i) * 2 - 9).otherwise(worth(i) * 2))
    return (n > 0) & (total % 10 == 0)


def mod97(hit: Column) -> Column:
    """True where an IBAN's check digits are right: letters as 10 to 35, the first four characters last, remainder 1."""
    plain = F.regexp_replace(hit, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    at = lambda i: F.substring(turned, i, F.lit(1))
    add = lambda a, i: F.when(at(i).rlike("[0-9]"), a * 10 + at(i).cast("int")).otherwise(a * 100 + F.ascii(at(i)) - 55) % 97
    return F.length(plain).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1)


def valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        d = digits(hit)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(digits(hit)).between(10, 15)
    if kind == "iban":
        return mod97(hit)
    if kind == "social":
        return ~hit.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "birth":
        day, month = r"(?:0?[1-9]|[12][0-9]|3[01])", r"(?:0?[1-9]|1[0-2])"
        return ~hit.rlike("^[0-9./-]+$") | hit.rlike(rf"^(?:[0-9]{{4}}-{month}-{day}|{day}[./]{month}[./](?:[0-9]{{2}}){{1,2}}|{month}[./]{day}[./](?:[0-9]{{2}}){{1,2}})$")
    return F.lit(True)


def _starts(gaps: Column, hits: Column) -> Column:
    """Where each match starts: after all gaps and matches before it. Running sums go by chunks, so that many matches cost little."""
    size = lambda x: F.coalesce(F.char_length(x), F.lit(0))
    steps = F.zip_with(gaps, hits, lambda g, m: F.struct(size(g).alias("g"), size(m).alias("m")))
    chunks = F.transform(F.sequence(F.lit(1), F.size(hits), F.lit(CHUNK)), lambda i: F.slice(steps, i, CHUNK))
    ints = F.array().cast("array<int>")
    inner = lambda c: F.aggregate(c, F.struct(F.lit(0).alias("at"), ints.alias("s")), lambda a, x: F.struct((a["at"] + x["g"] + x["m"]).alias("at"), F.concat(a["s"], F.array(a["at"] + x["g"])).alias("s")))
    walked = F.transform(chunks, inner)
    before = F.aggregate(walked, F.struct(F.lit(0).alias("at"), ints.alias("s")), lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["s"], F.array(a["at"])).alias("s")))["s"]
    return F.flatten(F.zip_with(walked, before, lambda w, b: F.transform(w["s"], lambda x: x + b)))


def found(text: Column, kind: str, pattern: str, gate: Column) -> Column:
    """array<struct<kind, hit, start, end, before, after>> of a pattern's leftmost non-overlapping matches; null where the gate is shut or nothing matches."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zipped = F.arrays_zip(hits.alias("hit"), _starts(gaps, hits).alias("start"), gaps.alias("before"), F.slice(gaps, 2, F.size(hits) + 1).alias("after"))
    return F.when(
        gate & (F.size(hits) > 0),
        F.transform(
            F.slice(zipped, 1, F.size(hits)),
            lambda x: F.struct(F.lit(kind).alias("kind"), x["hit"].alias("hit"), x["start"].alias("start"), (x["start"] + F.char_length(x["hit"])).alias("end"), F.right(x["before"], F.lit(NEAR)).alias("before"), F.left(x["after"], F.lit(NEAR)).alias("after")),
        ),
    )


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and spots: every match of every pattern, settled. The texts are read here and nowhere else."""
    t = F.col("t")
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.withColumns({"has_digit": t.rlike("[0-9][^A-Za-z]{0,3}[0-9]"), "has_at": F.contains(t, F.lit("@")), "has_plus": F.contains(t, F.lit("+"))})
    digit = F.col("has_digit")
    gates = {
        "email": (EMAIL, F.col("has_at")), "ip": (IP, digit & t.rlike(r"[0-9]\.[0-9]")), "card": (CARD, digit), "phone": (PHONE, F.col("has_plus")), "local_phone": (LOCAL_PHONE, digit), "social": (SOCIAL, digit),
        "iban": (IBAN, digit & t.rlike("[A-Z]{2}[0-9]{2}")), "spelled_email": (SPELLED, t.rlike(r"(?i)[\[(\x20]dot[\])\x20]")), "name": (NAME, t.rlike(r"\p{Lu}[\p{L}'’-]+\x20\p{Lu}|\p{Lu}[\p{L}'’-]+\x20(?:de|del|van|von|der|den|al|bin|da|di|la|el)\x20") | t.rlike(rf"(?:{TITLES})\.?\x20\p{{Lu}}")), "street": (STREET, t.rlike("[0-9]")),
        "birth": (BIRTH, digit), "passport": (PASSPORT, digit & t.rlike(rf"(?i){TELLS['passport']}")),
    }
    empty = F.array().cast("array<struct<kind:string,hit:string,start:int,end:int,before:string,after:string>>")
    per_kind = [F.coalesce(found(t, k, p, g), empty).alias(k) for k, (p, g) in gates.items()]
    return settle(d.select("id", *per_kind).select("id", F.concat(*BASE, *LOOSE).alias("spots")))


def observed(spot) -> dict[str, Column]:
    """The four votes and the features of a spot, given as anything with fields kind, hit, before, after, valid."""
    hit, kind, d = spot["hit"], spot["kind"], digits(spot["hit"])
    strict = F.when(~spot["valid"], -1).when(kind.isin(*BASE, "iban"), 1).otherwise(0)
    listed = (
        F.when(kind == "email", F.when(hit.rlike(rf"(?i)\.(?:{ENDINGS})$"), 1).otherwise(-1))
        .when(kind == "ip", F.when(hit.rlike(r"^(?:0|127|255|1\.0\.0)\."), -1).otherwise(1))
        .when(kind == "card", F.when(d.rlike(f"^(?:{ISSUERS})"), 1).otherwise(-1))
        .when(kind == "phone", F.when(d.rlike(f"^(?:{CODES})"), 1).otherwise(-1))
        .when(kind == "local_phone", F.when(F.length(d) == 7, 0).when(d.rlike("^[02-9]"), 1).otherwise(-1))
        .when(kind == "iban", F.when(hit.rlike(f"^(?:{BANKS})"), 1).otherwise(-1))
        .when(kind == "spelled_email", F.when(hit.rlike(rf"(?i)(?:{ENDINGS})$"), 1).otherwise(-1))
        .when(kind == "name", F.when(hit.rlike(rf"\b(?:{NO_NAMES})$"), -1).when(hit.rlike(rf"^(?:{GIVEN}|{TITLES})\b"), 1).otherwise(0))
        .when(kind == "street", F.when(hit.rlike("[0-9]"), 1).otherwise(-1))
        .otherwise(0)
    )
    tells = F.lit(None).cast("string")
    for k, told in TELLS.items():
        tells = F.when(kind == k, F.lit(rf"(?i)(?:{told})")).otherwise(tells)
    before, after = spot["before"], spot["after"]
    said = lambda x: F.coalesce(F.regexp_like(x, tells), F.lit(False))
    number = F.when(before.rlike(AGAINST) | after.rlike(AGAINST_AFTER), -1).when(said(before), 1).when(before.rlike(AGAINST_WEAK), -1).when(said(F.left(after, F.lit(12))), 1).otherwise(0)
    person = F.when(before.rlike(NAME_AGAINST) | after.rlike(NAME_AGAINST_AFTER), -1).when(before.rlike(NAME_BEFORE) | after.rlike(NAME_AFTER) | hit.rlike(rf"^(?:{TITLES})\b"), 1).otherwise(0)
    context = F.when(kind == "name", person).otherwise(number)
    n = F.length(d)
    form = (
        F.when(kind.isin("email", "spelled_email"), F.when(F.length(hit) <= 80, 1).otherwise(-1))
        .when(kind == "ip", F.when(F.length(hit) <= 15, 1).otherwise(-1))
        .when(kind == "card", F.when(n.isin(14, 15, 16, 19), 1).otherwise(-1))
        .when(kind == "local_phone", F.when(n.between(9, 13), 1).otherwise(0))
        .when(kind == "phone", F.when(n.between(10, 13), 1).otherwise(-1))
        .when(kind == "social", 1)
        .otherwise(0)
    )
    edge = lambda x: F.when(x == "", "none").when(x.rlike(r"[\x20\n]"), "gap").when(x.rlike("[A-Za-z0-9]"), "word").otherwise("mark")
    size = F.when(F.length(hit) < 12, "short").when(F.length(hit) <= 18, "middle").otherwise("long")
    word = F.lower(F.regexp_extract(spot["before"], r"(\p{L}+)[^\p{L}\p{N}]*$", 1))
    cue = F.when(word == "", "").when(word.isin(*CUES), word).otherwise("other")
    return {"v1": strict, "v2": listed, "v3": context, "v4": form, "kind": kind, "size": size, "left": edge(F.right(spot["before"], F.lit(1))), "right": edge(F.left(spot["after"], F.lit(1))), "cue": cue}


VOTES = ("v1", "v2", "v3", "v4")
FEATURES = ("kind", "size", "left", "right", "cue")
#: How often a vote of a labeler is taken to be right before any is seen, and for how many votes that counts.
AT_FIRST, WORTH = (0.95, 0.75, 0.9, 0.65), 40.0


def reliabilities(counts: list[tuple[tuple[int, ...], float]], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """EM over vote patterns: the probability of `personal` for each pattern.

    Each labeler has a distribution of votes per class; it starts from the majority's opinion and from AT_FIRST.
    """
    p = {v: min(0.9, max(0.1, 0.5 + 0.2 * sum(v))) for v, _ in counts}
    for _ in range(rounds):
        total = sum(n for _, n in counts)
        on = sum(n * p[v] for v, n in counts)
        prior = (on + 1) / (total + 2)
        like = []
        for k in range(len(counts[0][0]) if counts else 0):
            right = AT_FIRST[k] if k < len(AT_FIRST) else 0.75
            yes = {-1: WORTH * (1 - right), 0: WORTH / 2, 1: WORTH * right}
            no = {-1: WORTH * right, 0: WORTH / 2, 1: WORTH * (1 - right)}
            for v, n in counts:
                yes[v[k]] += n * p[v]
                no[v[k]] += n * (1 - p[v])
            like.append(({x: c / sum(yes.values()) for x, c in yes.items()}, {x: c / sum(no.values()) for x, c in no.items()}))
        for v, _ in counts:
            score = math.log(prior / (1 - prior)) + sum(math.log(y[x] / z[x]) for x, (y, z) in zip(v, like, strict=True))
            p[v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, score))))
    return p


def train(voted: DataFrame) -> tuple[dict[str, tuple[float, dict]], dict[str, dict[tuple[int, ...], float]]]:
    """The span classifier, by kind: the prior's log odds and those per value of each other feature, from one row per candidate; and
    what EM makes of each pattern of votes of that kind, whose labelers are judged by that kind's votes alone."""
    rows = voted.groupBy(*VOTES, *FEATURES).count().collect()  # bounded by the number of patterns
    weights, believed = {}, {}
    for kind in sorted({r["kind"] for r in rows}):
        votes: dict[tuple[int, ...], float] = {}
        for r in (r for r in rows if r["kind"] == kind):
            key = tuple(r[v] for v in VOTES)
            votes[key] = votes.get(key, 0) + r["count"]
        p = believed[kind] = reliabilities(sorted(votes.items()))
        both = [1.0, 1.0]
        each: dict[str, dict[str, list[float]]] = {f: {} for f in FEATURES if f != "kind"}
        for r in (r for r in rows if r["kind"] == kind):
            w, n = p[tuple(r[v] for v in VOTES)], r["count"]
            for k, x in enumerate((w * n, (1 - w) * n)):
                both[k] += x
                for f, seen in each.items():
                    seen.setdefault(r[f], [1.0, 1.0])[k] += x
        odds = {f: {x: math.log(y / (both[0] + len(seen)) * (both[1] + len(seen)) / z) for x, (y, z) in seen.items()} for f, seen in each.items()}
        weights[kind] = (math.log(both[0] / both[1]), odds)
    return weights, believed


def score(spot, weights: dict[str, tuple[float, dict]]) -> Column:
    """The classifier's log odds of an observed spot."""
    out = F.lit(0.0)
    for kind, (prior, odds) in weights.items():
        total = F.lit(prior)
        for f, of in odds.items():
            case = F.lit(0.0)
            for x, w in sorted(of.items()):
                case = F.when(spot[f] == x, F.lit(w)).otherwise(case)
            total = total + case
        out = F.when(spot["kind"] == kind, total).otherwise(out)
    return out


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and spans for every document: arrays of struct<start, rank, end, kind> in order of start, then kind."""
    spots = candidates(docs, id_col, text_col)
    checked = F.transform("spots", lambda x: x.withField("valid", F.coalesce(*[F.when(x["kind"] == k, valid(k, x["hit"])) for k in ("ip", "card", "phone", "iban", "social", "birth")], F.lit(True))))
    seen = F.transform("checked", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), (x["kind"].isin(*BASE) & x["valid"]).alias("base"), *[c.alias(n) for n, c in observed(x).items()]))
    spots = settle(spots.withColumn("checked", checked).select("id", seen.alias("seen")))
    weights, believed = train(spots.where(F.size("seen") > 0).select(F.inline("seen")))
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k).cast("int")
    span = lambda x: F.struct(x["start"].alias("start"), rank(x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))
    out = spots.withColumn("base", F.array_sort(F.transform(F.filter("seen", lambda x: x["base"]), span)))
    if not weights:
        return out.select(F.col("id").alias(id_col), "base", F.col("base").alias("spans"))
    # What a check or the context refutes is never added, whatever the others say; a name is personal only where the context says so.
    voted = lambda x: F.concat_ws(" ", x["kind"], *[x[v].cast("string") for v in VOTES])
    trust = {" ".join([k, *map(str, v)]): math.log(max(1e-9, share) / max(1e-9, 1 - share)) for k, p in believed.items() if k in LOOSE for v, share in p.items()}
    table = F.create_map(*[F.lit(x) for pair in (trust or {"": 0.0}).items() for x in pair])
    belief = lambda x: F.coalesce(F.try_element_at(table, voted(x)), F.lit(-1.0))
    favoured = lambda x: (x["v1"] >= 0) & (x["v3"] >= 0) & ((x["kind"] != "name") | (x["v3"] > 0)) & (x["v1"] + x["v2"] + x["v3"] + x["v4"] > 0) & (belief(x) > 0)
    loose = {k: w for k, w in weights.items() if k in LOOSE}
    more = F.filter("seen", lambda x: x["kind"].isin(*LOOSE) & favoured(x) & (score(x, loose) + belief(x) > 0) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return out.select(F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", F.transform(more, span))).alias("spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(documents(spark, sf_dir))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.size("spans").cast("long").alias("n_spans"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
