"""A general lexicon of abusive, hateful and sexual words in four languages (fixed values), by class.

No class holds sentences.  An insult counts fully with a degrading adjective or an
address beside it, a dehumanising word with a group of people.  Inflected forms come by rule."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

#: Vulgar insults, threats and curses that suffice alone.
STRONG_ABUSE = """fuck, fucker, fucking, fucked, motherfucker, cunt, bitch, asshole, arsehole, dickhead, dipshit, shithead, bullshitter, wanker, twat, prick,
scumbag, douchebag, jackass, dumbass, dumbfuck, retard, piece of shit, son of a bitch, bloody idiot, kill yourself, hang yourself, drop dead, go to hell, rot in hell, burn in hell,
shut your mouth, shut your face, shut up you, shut the hell up, kill you, hurt you, beat you up, smash your face, punch you, break your legs, break your neck, cut your throat,
slit your throat, wish you were dead, hope you die, hope you choke, hope you rot, should be shot, should be hanged, deserve to die, deserves to die, watch your back,
arschloch, arschlöcher, wichser, hurensohn, hurensöhne, missgeburt, fotze, schlampe, drecksau, drecksack, mistkerl, scheisskerl, halt die fresse, halt die klappe, halts maul, halt dein maul,
fick dich, verpiss dich, leck mich, fahr zur hölle, bring dich um, schlag dich,
connard, connasse, salaud, salope, enculé, ordure humaine, fils de pute, ta gueule, nique ta mère, va te faire foutre, va crever, va mourir, je vais te tuer, casse toi, bâtard,
hijo de puta, puta, puto, mierda, cabrón, gilipollas, pendejo, cállate la boca, vete a la mierda, vete al infierno, te voy a matar, te mueras, muérete, maricón, zorra de mierda"""
#: Nouns that insult a person.
INSULTS = """idiot, moron, imbecile, cretin, dimwit, halfwit, nitwit, loser, creep, clown, pig, bastard, cockroach, parasite, scum, weasel, leech, maggot, swine, rat, slob, fool, freak, liar,
crook, crackhead, dunce, simpleton, buffoon, lowlife, wretch, degenerate, pervert, psycho, shit, crap head,
idiota, imbécil, estúpido, estúpida, asqueroso, asquerosa, payaso, cerdo, inútil, miserable, basura humana, rata, parásito,
idiotin, trottel, dummkopf, depp, vollidiot, versager, schwein, widerling, abschaum, penner, drecksstück, verzieh dich, verprügeln, vermöbeln,
imbécile, abruti, crétin, débile, ordure, déchet, porc, raté, minable, parasite, pourriture, fumier, clochard"""
#: Adjectives that degrade, and words of a quarrel.
DEGRADING = """stupid, useless, worthless, pathetic, spineless, filthy, ugly, fat, lying, greasy, disgusting, dumb, brainless, miserable, smelly, rotten, ignorant, cowardly, slimy, dirty, vile, sick,
stinking, lazy, brain dead, retarded, crawl back, choke, chokes, die, rot, beaten, deserve, deserves, revenge, ashamed,
widerlich, widerlicher, dumm, dummer, dreckig, dreckiger, hässlich, ekelhaft, fett, fetter, solche, gros, grosse, sale, espèce de, espèce d, bande de, moche, puant, asco, feo, fea, gordo, gorda, sucio, sucia, maldito, maldita"""
#: Words that address a person.
ADDRESS = """you, your, yours, yourself, listen, whoever, du, dich, dir, dein, deine, ihr, euch, tu, te, toi, ton, ta, vous, votre, tú, eres, usted, ustedes, lárgate, cállate"""
#: Threats that need an address.
THREATS = """where you live, know your address, come for you, make you pay, be beaten, teach you a lesson, find you, weiss wo du wohnst, se donde vives, sais où tu habites"""
#: Groups of people and words that point at one.
GROUPS = """migrant, immigrant, foreigner, refugee, northerner, southerner, easterner, westerner, cripple, gay, lesbian, homosexual, transgender, muslim, jew, christian, hindu, atheist, arab, african,
asian, mexican, gypsy, black people, white people, old people, disabled people, poor people, women, men, girls, villager, peasant, those people, these people, such people,
their kind, they are, they all, them all, diese leute, solche leute, dieses pack, ausländer, flüchtlinge, migranten, juden, muslime, schwule, frauen, behinderte,
ces gens, ces gens là, étrangers, immigrés, migrants, juifs, musulmans, arabes, femmes, handicapés, esa gente, esta gente, extranjeros, inmigrantes, migrantes, judíos, musulmanes, mujeres, gitanos, discapacitados"""
#: What dehumanises a group.
DEHUMANISING = """vermin, savage, animals, degenerate, thieves, scum, filth, freak, plague, parasite, inferior, cockroach, rat, rats, disease, cancer, trash, garbage, monkey, apes, criminals,
dirty, disgusting, ungeziefer, gesindel, abschaum, schmarotzer, vermine, racaille, cafards, nuisibles, basura, escoria, plaga, ratas, alimañas"""
#: What belittles a group as a whole or would be rid of it.
EXCLUDING = """breed like, too dumb, too stupid, should be banned, throw them out, kick them out, drive them out, driven out, lock them up, get rid of them, wipe them out, exterminate, deport, go back to,
ausrotten, rausgeworfen, gehören vergast, weggesperrt, dehors, exterminer, dégage, echarlos, exterminar"""
#: Hate that suffices alone.
STRONG_HATE = """subhuman, untermensch, untermenschen, dreckspack, gas the, nigger, faggot, kike, tranny, ausländer raus, sale arabe, sale juif, sous hommes, putos moros"""
#: Sexual words that suffice alone.
STRONG_SEXUAL = """blowjob, handjob, cumshot, tits, titties, boobs, pussy, cock sucking, porn, porno, pornography, nudes, horny, slut, slutty, whore, hot sex, sex chat, sex tape, webcam sex, anal sex, oral sex, fuck me, dick pic,
explicit photos, explicit videos, see me naked, naked pics, nude pics, sexting, threesome, gangbang, orgasm, masturbate, bend over baby, milf, xxx,
titten, fotzen, geil auf dich, nacktbilder, pornofilm, pornos, seins nus, photos nues, salopes, bite, nichons, tetas, coño, polla, fotos desnuda, culo desnudo"""
#: Sexual words that need another.
SEXUAL = """sex, sexy, naked, nude, panties, erotic, explicit, moan, moans, lick, ass, boob, kinky, fetish, bend over, strip for, escort, camgirl,
nackt, erotisch, geil, nue, nu, érotique, desnudo, desnuda, erótico"""
#: Harmless phrases: what lies within one of them doesn't count.
EXCEPTIONS = """idiot proof, fool proof, kill for, killer price, dirty water, dirty dishes, dirty laundry, rat trap, rats nest, pest control, nude tone, nude colour,
nude color, nude lipstick, breast pump, unisex, single sex, dumb question, stupid question, stupidly good, piggy bank, money box, not to be beaten,
cant be beaten, can not be beaten, adult sizes, drop dead gorgeous, fat quarter, fat free, full fat, ugly sweater, clown fish, guinea pig, clown costume, dumb bell, strip lights, lick mat, smart ass, stupid simple,
thieves knot, rat poison, lazy susan, sick day, dirty hands, farm animals, stuffed animals, wild animals, bolsa de basura, cubo de basura, sac à ordure, boîte à ordure, cash cow, cock ring pliers, sale price, for sale, on sale, die cast, die cut"""


@dataclass(frozen=True)
class Entry:
    """A class of phrases: what kind they score as and by how much; whether they only count beside another of the
    kind, and whether several of them in a sentence add up or count once."""

    kind: str
    weight: float
    phrases: str
    context: bool = False
    adds: bool = False


LEXICON = (
    Entry("abuse", 1.0, STRONG_ABUSE), Entry("abuse", 0.6, INSULTS), Entry("abuse", 0.6, THREATS), Entry("abuse", 0.4, DEGRADING, True), Entry("abuse", 0.4, ADDRESS, True),
    Entry("hate", 1.0, STRONG_HATE), Entry("hate", 0.6, DEHUMANISING), Entry("hate", 0.6, EXCLUDING), Entry("hate", 0.4, GROUPS, True),
    Entry("sexual", 1.0, STRONG_SEXUAL), Entry("sexual", 0.6, SEXUAL, adds=True),
)


def bare(text: str) -> str:
    """Lower case without accents."""
    return "".join(ch for ch in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(ch))


def spellings(phrase: str) -> set[str]:
    """A phrase without accents, with German umlauts written out, and, if one word, its plural."""
    written = phrase.casefold()
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        written = written.replace(a, b)
    out = {bare(phrase), bare(written)}
    for p in [p for p in out if " " not in p and len(p) >= 3]:
        out |= {p + "s"} if p[-1] not in "sxz" else set()
        out |= {p + "es"} if p.endswith(("ch", "sh", "ss")) else set()
    return out


def phrases_of(text: str) -> list[str]:
    return sorted({s for p in text.split(",") if p.strip() for s in spellings(" ".join(p.split()))})
