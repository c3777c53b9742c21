"""A labelled list of ordinary identifiers for the secret scan.

Fixed words as code, paths and settings have them, written in the usual styles: snake_case, kebab-case, CONSTANT_CASE,
camelCase, PascalCase, paths, assignments, numbered and dated names, versions, rules of one sign. Every second word trains
and the others are held out, so that a threshold is set on identifiers of words that the model has not seen.
"""

from __future__ import annotations

import random

WORDS = """access account action active adapter address admin agent alert align allow amount analysis answer apache api app append archive
argument array article artifact asset assign async attach attempt attribute audio audit author auto average backend background backup balance
bank base batch before begin billing binary bind block body book boolean bootstrap boot bottom bound branch bridge browser bucket buffer build
bundle button byte cache calculate calendar callback cancel capture card cart catalog category cell center chain change channel character chart
check checkout child choose chunk circle city class clean clear click client clock close cloud cluster code codec collection color column com
command comment commit common company compare compile complete component compress compute config confirm connect constant contact container
content context control convert cookie copy core count country create credit current cursor custom customer daily dashboard data database date
debug decode default define delete deploy depth description design detail detect device dialog dict diff digest directory disable disk display
distance django dist docs document domain down download draft drive driver drop duration dynamic edge edit editor element email embed employee
empty enable encode end engine english ensure entity entry environment epoch error escape estimate event example except exchange execute exist
expand expect export express extend extension external extract factory fail fallback feature feed fetch field figure file fill filter final find
first flag float flow flush focus folder font foot force foreign format forward frame free frequency friend from front function future game gateway
general generate get git github global graph grid group guard guest guide handle handler hash head header health height help hide high history home
hook host hour html http icon identifier image import improve include index info init inner input insert inspect install instance integer interface
internal interval invalid inventory invoice issue item iterator java job join json jump keep kernel key keyboard keyword kind knowledge label lambda
language large last latest layer layout lazy lead left length level library license light limit line link list listen load local locale location lock
log login logger long loop lower machine mail main make manager map margin market mask master match matrix max measure media member memory menu merge
message meta method metric middle migrate min minute missing mobile mode model module monitor month mount mouse move multiple music name native
network new next node none normal notebook note notification null number object offset old online open operation option order organization origin
output override owner package page pair panel parameter parent parse part partition patch path pattern pause payment pending people percent perform
period permission person phone photo pipeline pixel place plain plan platform player plugin point policy pool popup port position post prefix prepare
press preview previous price primary print priority private process product profile program progress project prompt property protocol provider proxy
public publish pull purchase push python quality quantity query question queue quick quote random range rank rate ratio raw read ready real receive
record redirect reduce reference refresh region register release reload remote remove rename render repeat replace reply report repository request
require reset resize resolve resource response restart restore result retry return reverse review right role root rotate round route row rule run
runtime safe sample save scale scan schedule schema score screen script scroll search season second secret section secure segment select self send
sensor sequence series server service session set setting setup shadow shape share sheet shell shift shop short show side sign signal simple single
site size skip slice slot small snapshot social socket sort sound source space spark special speed split spring stable stack staff stage standard
start state static station statistics status step stop storage store stream street string structure student style subject submit subscribe success
suffix sum summary support switch symbol sync syntax system table tag target task team template temporary tensor term terminal test text theme thread
threshold thumbnail ticket time timeout timestamp title toggle token tool top topic total touch trace track traffic train transaction transform
translate transport tree trigger type union unique unit unknown unlock update upgrade upload upper url usage user username usr util valid validate
value variable vector vendor verify version vertical video view virtual visible visit volume wait wallet warning watch weather web week weight
widget width window with word work worker workflow workspace world wrap write year zero zone""".split()  # fmt: skip
JOINING = "and as at by for from if in is of on or to up with x id io is db os no".split()
SEPARATED = {"snake": "_", "kebab": "-", "path": "/", "constant": "_"}
STYLES = ("snake", "kebab", "constant", "camel", "pascal", "path", "assignment", "numbered", "dated", "version", "rule", "word")


def _words(rnd: random.Random, words: list[str], n: int) -> list[str]:
    got = [rnd.choice(words) for _ in range(n)]
    if n > 2 and rnd.random() < 0.4:
        got[rnd.randrange(1, n - 1)] = rnd.choice(JOINING)
    return [w + "s" if len(w) > 3 and rnd.random() < 0.1 else w for w in got]


def _one(rnd: random.Random, words: list[str], style: str) -> str:
    w = _words(rnd, words, rnd.randint(2, 6))
    date = f"{rnd.randint(1990, 2039)}-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02}"
    if style == "camel":
        return w[0] + "".join(x.title() for x in w[1:])
    if style == "pascal":
        return "".join(x.upper() if len(x) <= 4 and rnd.random() < 0.2 else x.title() for x in w)
    if style == "path":
        parts = [rnd.choice(("_", "-", "")).join(_words(rnd, words, rnd.randint(1, 2))) for _ in w]
        return rnd.choice(("/", "")) + "/".join(x.title() if rnd.random() < 0.1 else x for x in parts)
    if style == "assignment":
        return "_".join(w[:2]) + "=" + rnd.choice(("_", "-", "/", "+")).join(w[2:] or ["true"])
    if style == "numbered":
        sign = rnd.choice("_-/")
        return sign.join(w) + rnd.choice((sign, "")) + str(rnd.randint(0, rnd.choice((9, 99, 9999))))
    if style == "dated":
        sign = rnd.choice("_-/")
        return sign.join(rnd.choice(((*w, date), (date, *w), (*w, date.replace("-", "")), (date.replace("-", "/"), *w), (date, date))))
    if style == "version":
        return rnd.choice("_-/").join((*w, "v" + rnd.choice("-_").join(str(rnd.randint(0, 20)) for _ in range(3))))
    if style == "rule":
        return rnd.choice("-=_+/") * rnd.randint(20, 60)
    if style == "word":
        return "".join(w)
    out = SEPARATED[style].join(w)
    return out.upper() if style == "constant" else rnd.choice(("", "", "", "_", "__", "--")) + out if style != "path" else out


def made(words: list[str], each: int, seed: int) -> dict[str, list[str]]:
    """Of each style, identifiers from words, the same for the same seed."""
    rnd = random.Random(seed)
    return {style: [_one(rnd, words, style) for _ in range(each if style not in ("rule", "word") else each // 10)] for style in STYLES}


def trained(each: int = 1500) -> list[str]:
    return [x for xs in made(WORDS[::2], each, 1).values() for x in xs]


def held_out(least: int, each: int = 300) -> list[str]:
    """Identifiers of other words, of at least so many characters."""
    return [x for xs in made(WORDS[1::2], each, 2).values() for x in xs if len(x) >= least]
