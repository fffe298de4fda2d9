"""The labelled table that the personal-data model is trained on when no other one is given.

Sentences in English, German, French and Spanish: filled templates with spans of personal data, plain
sentences without, and prose of made-up words, so that unknown words alone tell nothing.
"""

from __future__ import annotations

import random
import re

#: text, and (start, end, kind) of its spans in code points
Row = tuple[str, list[tuple[int, int, str]]]

#: Frequent given names, which are also a feature of the model.
GIVEN_NAMES = (
    "Adam Alice Amanda Amy Andrew Angela Anna Anne Anthony Antonio Barbara Benjamin Brian Carlos Carmen Carol Caroline Catherine Charles Charlotte "
    "Christian Christine Christopher Claire Claudia Daniel David Diana Diego Donald Edward Elena Elizabeth Emily Emma Eric Eva Fernando Francis "
    "Francisco Frank François George Hans Hannah Heinrich Helen Henry Ines Isabel Jack Jacques James Jane Javier Jean Jennifer Jessica Joan Johann "
    "John Jonathan Jorge Joseph José Juan Julia Jürgen Karen Karl Katharina Kevin Klaus Laura Linda Lisa Louis Louise Lucas Lucia Luis Manuel "
    "Margaret Maria Marie Mark Martha Martin Mary Matthew Michael Michel Miguel Monika Nancy Nicolas Nicole Olivia Otto Pablo Patricia Paul Pedro "
    "Peter Philippe Pierre Rachel Ralf Richard Robert Rosa Ruth Sabine Samuel Sandra Sarah Simon Sofia Sophie Stefan Stephen Susan Teresa Thomas "
    "Ursula Victor Walter William Wolfgang Yves"
).split()
_OTHER_GIVEN = "Aroha Bogdan Chidi Dilnoza Eskil Farid Gudrun Hiroko Imre Jaspreet Kwame Leila Milos Ngozi Oksana Priya Rashid Soraya Tomasz Wanda".split()
_FAMILY = (
    "Abbott Bauer Becker Blanc Bonnet Carter Castro Cooper Dubois Evans Fournier Fuchs Garcia Gómez Hansen Hoffmann Hughes Ibáñez Jackson Keller "
    "Kowalski Lambert Lefèvre Lehmann López Marchand Mbeki Morales Müller Nakamura Novak Ortega Parker Petit Quinn Ramírez Richter Rossi Sánchez "
    "Schäfer Silva Singh Stone Suzuki Torres Turner Vogel Wagner Weiss Winkler Wright Yılmaz Zimmermann"
).split()

_TEMPLATES = (
    "My name is {person}.", "Hello, my name is {person} and I live here.", "his name is {person} and he left.", "She is called {person} by her friends.",
    "Ask Mr. {family} about it.", "We met Mrs {family} in town, then Dr. {family} came.", "Prof. {person} wrote the report.", "Please contact {person} tomorrow.",
    "{person} lives in the old town.", "{person} was born in the north and moved away.", "Regards, {person}", "Kind regards,\n{person}", "Signed by {person}.",
    "I talked to {person} on Monday.", "The letter was sent to {person}, who never answered.", "According to {person}, the work is done.", "with {person} and {person}",
    "Dear {person},", "Yesterday {person} and {person} went home.", "a book by {person}", "Contact: {person}", "Name: {person}",
    "Ich heiße {person} und wohne hier.", "Mein Name ist {person}.", "Herr {family} und Frau {family} kommen heute.", "Gestern hat {person} angerufen.",
    "Mit freundlichen Grüßen, {person}", "{person} wohnt in der Stadt.", "Das Buch von {person} ist gut.",
    "Je m'appelle {person}.", "Mon nom est {person}, merci.", "Madame {family} est partie avec Monsieur {family}.", "{person} habite à la campagne.", "selon {person}, tout va bien",
    "Cordialement, {person}", "Me llamo {person}.", "mi nombre es {person} y vivo aquí.", "La señora {family} habló con don {given}.", "{person} vive en el campo.",
    "Un saludo, {person}", "ayer vino {person} con su hermano",
    "Call {local} today.", "call {local}", "My phone is {local}, please call.", "tel: {local}", "Tel. {local}", "Phone {local} or fax {local}.", "you can reach me at {local} any time",
    "Telefon: {local}", "Mon téléphone : {local}.", "teléfono {local} por favor", "mobile ({local})", "Ruf mich an, {local} ist die Nummer.", "the number is {local}",
    "Appelez le {local} ce soir.", "llame al {local} hoy", "we wrote many words before, and then the number {local} came",
    "mail me: {spoken}", "Write to {spoken} soon.", "my email is {spoken}.", "contact {spoken} for help", "Schreib an {spoken}.", "correo: {spoken}", "e-mail {spoken}",
    "courriel : {spoken}", "reach us via {spoken}",
    'token = "{secret}"', "api_key = {secret}", "API key: {secret}", "password: {secret}", "export SECRET={secret}", "the access token is {secret}", "Passwort: {secret}",
    'secret = "{secret}" and more words', "auth_token={secret}", "mot de passe : {secret}", "contraseña: {secret}", 'with key = "{secret}" in the text',
)

_PLAIN = (
    "The cat sat on the mat and looked at me.", "In 1984 the house was sold for 120 000 dollars.", "It is what it is, they said.", "Version 2.0, released on 12-05-2019.",
    "All rights reserved.", "She will call at noon.", "Look at the dot on the map.", "The name of the rose is a book.", "My house is red and yours is blue.",
    "The train to New York leaves at 10:45.", "The United Nations met in Geneva.", "On Monday the Bank of England raised rates.", "He read The Times on Sunday.",
    "Chapter 3 ends on page 1200.", "Order 4711 was shipped.", "ISBN 978-3-16-148410-0", "See RFC 2616, section 14.", "Pi is 3.14159265358979.", "Prices: 1,200, 3,400 and 5,600.",
    "Der Hund ist im Haus.", "Die Regierung hat das Gesetz im Bundestag beschlossen.", "Ich bin es.", "Das Haus am See gehört der Stadt Köln.", "Am Anfang war das Wort.",
    "Die Deutsche Bahn fährt heute nicht.", "La maison est grande et le jardin aussi.", "Point final, dit on.", "Tel quel, me dit on.", "La Cour des comptes a publié le rapport.",
    "Le Monde est un journal.", "Elle est à Paris depuis mardi.", "El perro es de mi hermano.", "Que es de la casa, me dijo.", "Mi casa es grande.", "El Gobierno aprobó la ley en Madrid.",
    "Los Reyes llegan en enero.", "Name: unknown", "127.0.0.1 is home", "The key is under the mat.", "a token of friendship", "Keep it secret.", "The password is not written here.",
    "commit 9fceb02d0ae598e95dc970b74767f19372d61af8", "sha256 e3b0c44298fc1c149afbf4c8996fb924", "x = 12", "if a = b then c = d", "WARNING: NOT FOR SALE", "Is it at home?", "and, by the way, come",
    "from 100 - 200 to 300 - 400", "2019 - 2020 was cold", "room 101 - 102 - 1030 is closed", "the score was 3 - 2 in 90 minutes", "A | B | C | 12 | 345 |", "Phone it in.", "Mail comes at ten.",
    "He met a friend, at the gate, and left.", "dot by dot, line by line", "This is de facto law.", "1 2 3 4 5 6", "12 345 678 people", "Madrid, Paris and Berlin are cities.",
    "January, February and March were wet.", "Microsoft Windows and Apple Macintosh are names of systems.", "North America and South Africa", "World War Two ended then.",
    "The Golden Gate Bridge is long.", "General Public License", "Supreme Court of the United States", "Is This The Title Of A Story", "Terms And Conditions Apply",
)
_CONSONANTS, _VOWELS = "bcdfghjklmnprstvwyz", "aeiouäéóü"


#: Share of templates in which half of the lower-case words give way to made-up ones: frames of languages that the table lacks.
UNKNOWN_FRAMES = 0.4


def _word(r: random.Random) -> str:
    return "".join(r.choice(_CONSONANTS) + r.choice(_VOWELS) + r.choice(("", "", "n", "s", "r", "th")) for _ in range(r.randint(1, 4)))


def _unknown(text: str, r: random.Random) -> str:
    return re.sub(r"\b[a-zà-ÿ]+\b", lambda m: _word(r) if r.random() < 0.5 else m[0], text)


def _made_up(r: random.Random) -> str:
    """Prose of words that no language has, with names, numbers and cue words nowhere near each other."""
    words = [_word(r) + r.choice(("", "", "", "", ",")) for _ in range(r.randint(1, 24))]
    frequent = "the of and in is at de me es mi est un une der die und la el le que not name call mail dot com".split()
    words = [str(r.randint(0, 10 ** r.randint(1, 12))) if r.random() < 0.03 else r.choice(frequent) if r.random() < 0.15 else w for w in words]
    words = [w + r.choice(("##", "***", "!!", "&&")) if r.random() < 0.02 else w for w in words]
    return " ".join(words).capitalize() + r.choice((".", ".", "!", "?", ""))


def labelled_table(seed: int = 11, templates: tuple[str, ...] = _TEMPLATES, given: list[str] | None = None, family: list[str] | None = None, copies: int = 4) -> list[Row]:
    """Each template `copies` times, filled at random; plain sentences; made-up prose, alone and around templates."""
    r = random.Random(seed)
    given, family = given or [*GIVEN_NAMES, *(_OTHER_GIVEN * 6)], family or _FAMILY
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def number() -> str:
        d = digits
        return r.choice((f"{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}"))

    def secret() -> str:
        kind = r.choice(("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))
        return r.choice("ab") + r.choice("123") + "".join(r.choice(kind) for _ in range(r.choice((14, 18, 30, 38, 62))))

    def value(part: str) -> tuple[str, str]:
        if part == "local":
            return number(), "local_phone"
        if part == "secret":
            return secret(), "secret"
        if part == "spoken":
            at, dot = r.choice((("at", "dot"), ("at", "dot"), ("at", "punkt"), ("arobase", "point"), ("arroba", "punto")))
            return f"{r.choice(given).lower()} {at} {r.choice(('mail', 'example', 'post', 'web'))} {dot} {r.choice(('com', 'org', 'net', 'de', 'fr'))}", "spoken_email"
        names = {"given": r.choice(given), "family": r.choice(family)}
        middle = r.choice(("", "", "", " " + r.choice("ABCDEFGHJKLM") + "."))
        return names.get(part, f"{names['given']}{middle} {names['family']}"), "person"

    rows: list[Row] = []
    for template in templates * copies:
        out, spans = "", []
        strange = r.random() < UNKNOWN_FRAMES
        if r.random() < 0.3:
            out = _made_up(r).rstrip("!?.,") + r.choice((". ", " ", ", "))
        for k, part in enumerate(re.split(r"\{(\w+)\}", template)):
            text, kind = value(part) if k % 2 else (_unknown(part, r) if strange else part, "")
            if kind:
                spans.append((len(out), len(out) + len(text), kind))
            out += text
        rows.append((out, spans))
    plain = [text for text in _PLAIN for _ in range(4)] + [_made_up(r) for _ in range(60 * copies)]
    return rows + [(_altered(text, r), []) for text in plain]


def _altered(text: str, r: random.Random) -> str:
    """Most texts as they are; some shouted, with marks after words, or with a word or two said over and over."""
    pick = r.random()
    words = text.split(" ")
    if pick < 0.12:
        return " ".join(w.upper() + r.choice(("", "!!")) for w in words)
    if pick < 0.17:
        mark = r.choice(("***", "!!", "&&", " |", " -"))
        return " ".join(w + mark for w in words)
    if pick < 0.30:
        again = r.sample(words, min(len(words), r.choice((1, 1, 2))))
        case = r.choice((str.lower, str.lower, str.capitalize))
        return " ".join(case(w) for w in again for _ in range(r.randint(2, 12))) + " " + text
    return text
