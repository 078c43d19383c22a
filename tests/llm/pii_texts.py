"""Labelled sentences that the rules of problem 7 were not written from: {kind|item}.

SEEN was looked at while the rules were generalized, HELD_OUT was not; README gives the figures of both.
"""

SEEN = [
    "{name|John Smith} went home before the storm.",
    "Yesterday I met {name|Maria Gonzalez} at the station.",
    "Please forward it to {email|j.doe+lists@example.co.uk} by Friday.",
    "You can call {phone|5551234567} after six.",
    "Her office line is {phone|(212) 867-5309}, ext. not needed.",
    "Ring {phone|+44 20 7946 0958} and ask at the desk.",
    "The bill was paid with card {account|4111 1111 1111 1111} last week.",
    "Transfer to IBAN {account|DE89 3704 0044 0532 0130 00} before May.",
    "Send the refund to {account|GB29NWBK60161331926819}, thanks.",
    "My social security number is {identity|219-09-9999}.",
    "SSN: {identity|457-55-5462}",
    "Passport number {identity|X1234567} expires soon.",
    "We live at {address|221B Baker Street} in London.",
    "Deliver to {address|742 Evergreen Terrace}, Springfield.",
    "The shop is at {address|10 Downing St.}, near the park.",
    "Dr. {name|Watson} will see you now.",
    "Mrs. {name|Eleanor Rigby} waits at the window.",
    "Contact {name|Peter Parker} or {name|Mary Watson} for details.",
    "Ich heiße {name|Anna Schmidt} und wohne in der {address|Hauptstraße 12}.",
    "Meine Steuer-ID lautet {identity|86 095 742 719}.",
    "Rufen Sie mich unter {phone|030 1234567} an.",
    "Herr {name|Müller} ist heute nicht da.",
    "Je m'appelle {name|Claire Dubois} et j'habite {address|15 rue de la Paix}.",
    "Mon numéro est le {phone|06 12 34 56 78}.",
    "Numéro de sécurité sociale : {identity|2 55 08 14 168 025 38}",
    "Me llamo {name|Carlos Ruiz}, mi DNI es {identity|12345678Z}.",
    "Vivo en {address|Calle Mayor 25} desde 2010.",
    "Llámame al {phone|+34 612 345 678} por la tarde.",
    "Nazywam się {name|Jan Kowalski}, PESEL {identity|44051401359}.",
    "Mieszkam przy {address|ul. Długa 7/3} w Krakowie.",
    "Меня зовут {name|Иван Петров}, тел. {phone|+7 495 123-45-67}.",
    "Адрес: {address|ул. Ленина, д. 5, кв. 12}.",
    "Write to me at {email|maria dot lopez at example dot com} please.",
    "{name|Sarah Connor} and {name|David Miller} signed the letter.",
    "The author, {name|George Brown}, declined to comment.",
    "It was {name|Emma Wilson}'s idea.",
    "The file has 86095742710 rows in it.",
    "New York and Los Angeles are large cities.",
    "Chapter 12 of the Oxford Press edition, ISBN 978-3-16-148410-0.",
    "On Monday Morning the train left King Street Station.",
    "version 10.4.2 build 20231105 of the model",
    "The total was 1,234,567 samples at 16000 Hz.",
    "In January March winds blew over Charlotte Town.",
]

HELD_OUT = [
    "{name|Thomas Baker} left the keys on the table.",
    "I spoke with {name|Laura Martin} about the lease.",
    "Her brother {name|Daniel Evans} is a carpenter.",
    "Questions go to {email|help_desk-7@mail.example.org}.",
    "reach us via {email|info [at] example [dot] net} any time",
    "Telephone {phone|0161 496 0123} between nine and five.",
    "My cell is {phone|415-555-2671}.",
    "Fax: {phone|+49 89 636 48018}",
    "WhatsApp {phone|+1 (650) 253-0000} works best.",
    "He paid with {account|5500 0000 0000 0004} online.",
    "Amex {account|3782 822463 10005} was declined.",
    "IBAN {account|FR14 2004 1010 0505 0001 3M02 606} is the club's.",
    "Use {account|NL91ABNA0417164300} for the deposit.",
    "His SSN, {identity|078-05-1120}, was printed on the card.",
    "National insurance number {identity|AB 12 34 56 C} is required.",
    "passport no. {identity|C01X00T47} was reported lost",
    "She moved to {address|1600 Pennsylvania Avenue} years ago.",
    "Our clinic: {address|48 Elm Grove Road}, first door left.",
    "Prof. {name|Higgins} gave the lecture.",
    "Ms. {name|Olivia Turner} will reply.",
    "Mein Name ist {name|Lukas Weber}.",
    "Sie wohnt in der {address|Goethestraße 44}.",
    "Frau {name|Schneider} hat angerufen.",
    "Tel.: {phone|0221 4710815}",
    "Madame {name|Lefèvre} habite {address|8 avenue Victor Hugo}.",
    "Je suis {name|Julien Moreau}, téléphone {phone|01 42 68 53 00}.",
    "Mi nombre es {name|Lucía Fernández}.",
    "Su NIE es {identity|X1234567L}.",
    "La oficina está en {address|Avenida de América 14}.",
    "Pan {name|Nowak} czeka na odpowiedź.",
    "Adres: {address|al. Jerozolimskie 56}, Warszawa.",
    "Numer PESEL {identity|02070803628} podano w umowie.",
    "Госпожа {name|Смирнова} живёт здесь: {address|пр. Мира, д. 20}.",
    "Звоните: {phone|8 (812) 555-01-23}.",
    "Later {name|Robert Hughes} and {name|Alice Cooper} joined them.",
    "The editor {name|Michael Stone} sent it to {email|m.stone@example.com}.",
    "The river rose 12345678 times in the old song.",
    "Great Western Railway opened in Summer 1838.",
    "See section 4.12.3, table 7, page 1024.",
    "order 2023-11-05-0042 shipped from Port Arthur",
    "The North Sea and the Baltic Sea are cold.",
    "checksum 4111111111111112 failed",
    "Victoria Station and Lincoln Park were empty.",
    "He scored 219-209 in the final.",
]


def parsed(marked):
    """(text, [(first, end, kind)]) of a marked sentence."""
    text, spans = "", []
    while "{" in marked:
        before, _, rest = marked.partition("{")
        item, _, marked = rest.partition("}")
        kind, _, value = item.partition("|")
        text += before
        spans.append((len(text), len(text) + len(value), kind))
        text += value
    return text + marked, spans


def measured(find, sentences):
    """(recall, precision, missed, wrong) of ``find`` over marked sentences."""
    missed, wrong, right = [], [], 0
    for marked in sentences:
        text, spans = parsed(marked)
        got = set(find(text))
        right += len(got & set(spans))
        missed += [(k, text[a:b]) for a, b, k in spans if (a, b, k) not in got]
        wrong += [(k, text[a:b]) for a, b, k in got if (a, b, k) not in spans]
    return right / (right + len(missed)), right / max(1, right + len(wrong)), missed, wrong
