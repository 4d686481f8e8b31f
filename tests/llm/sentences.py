"""Sentences written by hand, none by the patterns of the training lines: people,
numbers and addresses of many countries. {n:…} is a name, {e:…} an email, {p:…} a
phone number, {i:…} a person's number, {a:…} a street address."""

SENTENCES = tuple(
    line
    for line in """
The minutes were taken by {n:Oluwaseun Adebayo} and approved a day later.
If anything is unclear, forward this to {n:Hiroshi Tanaka}.
The annex was drafted by {n:Chen Wei} and {n:Sarah O'Connor}.
Yesterday {n:Max Mustermann} returned the keys.
For help just call {p:9876543210} before six.
His Aadhaar {i:1234 5678 9012} was checked at the counter.
Could {n:Priya Raghunathan} look at the second page?
The keynote by {n:Marisol Echeverría} starts at nine.
Rent is collected by {n:Thabo Mokoena} on the first of the month.
Nobody but {n:Ingrid Sørensen} had the code.
We later learned that {n:Aleksandra Wójcik} had left the company.
The complaint came from {n:Fatima Al-Sayed}, not from the shop.
Ask {n:Giovanni Bellandi} whether the crates are dry.
A copy goes to {n:Dmitri Volkov} and to {n:Yuki Nakamura}.
The heirs are {n:Beatriz Carvalho} and {n:Rui Carvalho}.
It is signed {n:T. Lindqvist} in blue ink.
Her successor, {n:Amara Okafor}, starts in June.
The lease names {n:Patrick J. Whelan} as tenant.
Interview with {n:Noor Jahan} on Tuesday, half past two.
The prize went to {n:Svetlana Petrova}.
Mr. {n:Abernathy} declined the offer.
Speak to Dr. {n:Ramaswamy} about the results.
{n:Lucas Meyer} drove the van to the depot.
{n:Zsófia Kovács} repaired the scanner on her own.
Handwritten note: thank you, {n:Imran Qureshi}!
The room was booked under {n:Hannah Weiss}.
Write to {e:h.tanaka@example.org} or to {e:sales-team@shop.example.com}.
Her address is {e:oluwaseun_adebayo+work@mail.example.net}, not the old one.
You can reach the caretaker at {e:keeper (at) house.example}.
Ring {p:+1 415 555 0132} after lunch.
The hotline is {p:+49 89 1234567}.
Leave a message under {p:(212) 555-0187}.
My new number: {p:+44 7700 900123}
Fax it to {p:+33 1 40 20 50 50} please.
From abroad dial {p:+81 3-5555-0123}.
The guard answers {p:020 7946 0018} at night.
She showed passport {i:K8273645} at the border.
His SSN {i:078-05-1120} was printed twice.
PESEL {i:44051401359} appears on the form.
The driver's licence {i:AB 1234567} had expired.
They live at {a:42 Wallaby Way} in a blue house.
The office moved to {a:1600 Amphitheatre Avenue}.
Bring the parcel to {a:17 Church Lane, Flat 3} by noon.
The shop stands at {a:Hauptstraße 15} near the station.
Er wohnt in der {a:Lindenallee 7b} seit Jahren.
Le bureau se trouve {a:12, rue de Rivoli} depuis mai.
Vive en {a:Calle Mayor 23} con su hermana.
Przesyłkę odebrano przy {a:ul. Marszałkowska 10/12} wczoraj.
The meeting at {a:9 Elm Street} was short.
The crate weighs 42 kilos and holds Granny Smith apples.
Delivery by Blue Ribbon Logistics to the Northern Depot.
Order 5500123456 was packed at the Central Warehouse.
The Annual General Meeting takes place in Upper Hall.
Please read Section Four of the Purchase Agreement.
Flight times are shown in Central European Time.
The Quality Assurance Team tested lot 123-45-6789.
Sales rose in New Zealand and in South Korea.
The Treaty of Westphalia is not mentioned here.
""".strip().split("\n")
)

KINDS = {"e": 0, "p": 1, "i": 2, "a": 3, "n": 4}


def marked(line: str) -> tuple[str, set[tuple[int, int, int]]]:
    """A sentence and its spans (begin, end, type)."""
    import re

    text, gold, at = "", set(), 0
    for m in re.finditer(r"\{(\w):([^}]*)\}", line):
        text += line[at : m.start()]
        gold.add((len(text), len(text) + len(m[2]), KINDS[m[1]]))
        text += m[2]
        at = m.end()
    return text + line[at:], gold
