"""Synthetic documents with known boundaries: templates for each kind of unit, in several formats and two languages, filled from
pools by arithmetic on the numbers of the document and the unit, so that a corpus is the same wherever and however often it
is made, and SQL can make it too."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .labels import join_units

LANGS = ("en", "pt")
#: Pools: what to choose from in each language, and the factors of document and unit and the summand that choose.
POOLS: dict[str, tuple[tuple[list[str], list[str]], int, int, int]] = {}


def pool(names: str, english: str, portuguese: str, *places: tuple[int, int, int]) -> None:
    for name, (a, b, c) in zip(names.split(), places):
        POOLS[name] = ((english.split(";"), portuguese.split(";")), a, b, c)


pool(
    "topic other",
    "billing;late delivery;returns;shared accounts;privacy;night support;shipping;warranty;card payments;data export;parking permits;meal plans;library loans;exam dates",
    "cobrança;entrega atrasada;devoluções;contas conjuntas;privacidade;suporte noturno;frete;garantia;pagamento com cartão;exportação de dados;vagas de garagem;plano de refeições;empréstimo de livros;datas de prova",
    (3, 5, 0), (5, 3, 1),
)
pool(
    "name second",
    "Anna Holt;John Reed;Martha Stone;Paul Klein;Rita Moss;Owen Clarke;Lucy Park;Dev Patel;Ivy Brandt;Sam O'Neil;Grace Lund",
    "Ana Lima;João Prado;Marta Souza;Paulo Brito;Rita Alves;Caio Nunes;Lúcia Paz;Davi Rocha;Inês Braga;Téo Moura;Graça Leal",
    (1, 2, 0), (2, 1, 3),
)
pool(
    "place city",
    "Leeds;Bonn;Derby;Quebec;Dover;Ghent;Perth;Cork;Salem",
    "Lisboa;Recife;Porto;Natal;Braga;Belém;Évora;Campinas;Faro",
    (2, 3, 1), (4, 5, 2),
)
pool(
    "s1 s2 s3",
    "The team reads each request within two days;Most cases end without a second visit;A copy goes to the office that asked for it;Nobody has to wait in line for this;The form is the same for every branch;Costs are shared by all departments;Old records stay in the archive for ten years;What is agreed by phone is sent by letter too;The rule was changed after the spring review;Anyone may ask to see the figures;Two signatures are needed for larger sums;Weekends do not count as working days",
    "A equipe lê cada pedido em até dois dias;A maioria dos casos termina sem nova visita;Uma cópia vai para o setor que a pediu;Ninguém precisa esperar na fila por isso;O formulário é o mesmo em todas as unidades;Os custos são divididos entre os setores;Registros antigos ficam dez anos no arquivo;O que se combina por telefone segue por carta;A regra mudou depois da revisão de março;Qualquer pessoa pode pedir para ver os números;Valores maiores exigem duas assinaturas;Fins de semana não contam como dias úteis",
    (7, 5, 0), (5, 7, 4), (11, 3, 8),
)
pool(
    "f1 f2 f3",
    "where the work goes on much as it did before the move,;and a good part of what was planned for the autumn;has been put off until the new rooms are ready for use;while those who came early were shown the older wing;with its long tables and the maps that nobody reads;since the last meeting left the matter open once more;though it is said that a decision is not far away now;so that the papers could be sent out before the break",
    "onde o trabalho segue quase como antes da mudança,;e boa parte do que se planejou para o outono;ficou para quando as salas novas estiverem prontas;enquanto quem chegou cedo conheceu a ala antiga;com suas mesas compridas e mapas que ninguém lê;pois a última reunião deixou o assunto em aberto;embora se diga que a decisão já não está longe;para que os papéis saíssem antes do recesso",
    (3, 5, 0), (5, 3, 2), (7, 2, 5),
)
pool("role", "engineer;tutor;clerk;nurse;editor;driver;planner", "engenheira;tutor;escrivã;enfermeiro;editora;motorista;planejador", (2, 3, 0))
pool("day", "Monday;Tuesday;Wednesday;Thursday;Friday", "segunda;terça;quarta;quinta;sexta", (1, 3, 0))
pool("month", "January;March;May;June;September;November", "janeiro;março;maio;junho;setembro;novembro", (1, 1, 0))
pool("word", "cache;queue;parser;index;socket;worker;ledger", "cache;fila;parser;índice;socket;tarefa;livro", (3, 2, 1))
pool("flag", "true;false;n/a", "true;false;n/a", (1, 1, 0))
#: Of a number: the document's factor, to which the unit's number is added, the modulus, and the least one.
NUMBERS = {"n": (0, 1000, 1), "hour": (1, 10, 9), "minute": (7, 49, 10), "year": (3, 33, 1991), "amount": (37, 880, 120)}

#: Kind: for each language the formats of one unit. A document keeps to one.
KINDS: dict[str, tuple[list[str], list[str]]] = {
    "qa_script": (["How does {topic} work?\n{s1}. {s2}.\n", "Q: How does {topic} work?\nA: {s1}. {s2}.\n"], ["Como funciona: {topic}?\n{s1}. {s2}.\n", "P: Como funciona: {topic}?\nR: {s1}. {s2}.\n"]),
    "bullet_qa": (
        ["- **Q{n}: What about {topic}?**\n- A: {s1}.\n", "### What about {topic}?\n- {s1}.\n- {s2}.\n\n", "* What about {topic}?\n  {s1}.\n", "{n}. What about {topic}?\n   {s1}.\n"],
        ["- **P{n}: E {topic}?**\n- R: {s1}.\n", "### E {topic}?\n- {s1}.\n- {s2}.\n\n", "* E {topic}?\n  {s1}.\n", "{n}. E {topic}?\n   {s1}.\n"],
    ),
    "schedule": (
        ["**Session:** {topic}\n**Time:** {hour}:00\n**Room:** {n}\n\n", "{day}, {hour}:30 - {topic}\nSpeaker: {name}\nRoom {n}, {place}\n\n"],
        ["**Sessão:** {topic}\n**Hora:** {hour}:00\n**Sala:** {n}\n\n", "{day}, {hour}h30 - {topic}\nPalestrante: {name}\nSala {n}, {place}\n\n"],
    ),
    "faq": (["### {n}. Can I change {topic}?\n\n{s1}. {s2}.\n\n", "**Can I change {topic}?**\n\n{s1}.\n\n", "Can I change {topic}?\n\n{s1}. {s3}.\n\n"], ["### {n}. Posso mudar {topic}?\n\n{s1}. {s2}.\n\n", "**Posso mudar {topic}?**\n\n{s1}.\n\n", "Posso mudar {topic}?\n\n{s1}. {s3}.\n\n"]),
    "sectioned": (
        ["About {topic}\n\n{s1}. {s2}. {s3}.\n\n", "## About {topic}\n\n{s1}. {s2}.\n\n", "About {topic}\n===========\n\n{s1}. {s2}.\n\n", "{n}. ON {city} AND OTHERS\n\n{s1}. {s3}.\n\n"],
        ["Sobre {topic}\n\n{s1}. {s2}. {s3}.\n\n", "## Sobre {topic}\n\n{s1}. {s2}.\n\n", "Sobre {topic}\n===========\n\n{s1}. {s2}.\n\n"],
    ),
    "bio": (["{name}\n{role}, {city}\nWorks on {topic}; {s1}. {s2}.\n\n", "**{name}** ({year}), {role} in {city}. {s1}.\n\n"], ["{name}\n{role}, {city}\nTrabalha com {topic}. {s1}. {s2}.\n\n", "**{name}** ({year}), {role} em {city}. {s1}.\n\n"]),
    "entity_list": (["{name}: {topic}, {place}. {s1}.\n", "{name} ({place}) - {topic}. {s1}.\n"], ["{name}: {topic}, {place}. {s1}.\n"]),
    "repeated_header": (["RECORD\nOf {name}, on {topic}: {s1}.\n", "Entry\nDate: {n} {month} {year}\n{s1}. {s2}.\n"], ["REGISTRO\nDe {name}, sobre {topic}: {s1}.\n"]),
    "colon_header": (["On {topic}:\n{s1}.\nAlso {other}.\n", "{place}:\n{s1}. {s2}.\n"], ["Sobre {topic}:\n{s1}.\nTambém {other}.\n"]),
    "legal_articles": (
        ["Article {n} - On {topic}, the parties agree as follows. {s1}.\n", "Section {n}. {s1}.\n(a) on {topic};\n(b) on {other}.\n\n", "§ {n} {s1}. {s2}.\n"],
        ["Art. {n} Sobre {topic}, dispõe-se o seguinte. {s1}.\n", "Art. {n} {s1}.\nI - {topic};\nII - {other}.\n\n", "Cláusula {n} - {s1}. {s2}.\n"],
    ),
    "chat_log": (["[10:{minute}] {name}: on {topic}, {s1}.\n", "{name}: {s1}.\n", "<{name}> {s1}, and {topic}?\n"], ["[10:{minute}] {name}: sobre {topic}, {s1}.\n", "{name}: {s1}.\n", "<{name}> {s1}, e {topic}?\n"]),
    "email_thread": (["From: {name}\nTo: {second}\nSubject: {topic}\n\nHello,\n\n{s1}. {s2}.\n\n"], ["De: {name}\nPara: {second}\nAssunto: {topic}\n\nOlá,\n\n{s1}. {s2}.\n\n"]),
    "changelog": (["## 1.{n}.0\n- fix {word}\n- add {other}\n\n", "Version 2.{n} ({year})\n* {word}: {s1}\n* {other}\n\n"], ["## 1.{n}.0\n- corrige {word}\n- inclui {other}\n\n"]),
    "readme_doc": (["## Step {n}\n\nInstall the {word}, then call `run {word}`. {s1}.\n\n```\nrun --{word}\n\nend\n```\n\n"], ["## Passo {n}\n\nInstale o {word} e chame `run {word}`. {s1}.\n\n```\nrun --{word}\n\nend\n```\n\n"]),
    "steps_doc": (["{n}. Open the page on {topic}.\n   {s1}.\n", "Step {n}: open the page on {topic}. {s1}.\n"], ["{n}. Abra a página de {topic}.\n   {s1}.\n", "Passo {n}: abra a página de {topic}. {s1}.\n"]),
    "wrapped_prose": (["{place} has much to do with {topic},\n{f1}\n{f2}\n{f3}.\n\n", "In {place}, {f2}\n{f3},\n{f1} as on {topic}.\n\n"], ["{place} tem muito a ver com {topic},\n{f1}\n{f2}\n{f3}.\n\n"]),
    "hyphenated_wrap": (["In {place} the de-\npartment of {topic} says that {f1} de-\nspite {other}, as of {year}.\n\n"], ["Em {place} o depar-\ntamento de {topic} diz que {f1} ape-\nsar de {other}, desde {year}.\n\n"]),
    "dense_field": (["Name: {name} | Place: {place} | Topic: {topic} | Note: {s1}\n", "Name: {name}\nPlace: {place}\nTopic: {topic}\nAmount: {amount}\n\n"], ["Nome: {name} | Local: {place} | Tema: {topic} | Nota: {s1}\n", "Nome: {name}\nLocal: {place}\nTema: {topic}\nValor: {amount}\n\n"]),
    "roster_block": (["{name} - {topic}\n{second} - {other}\n\n", "{day}\n{name} ({role})\n{second}\n\n"], ["{name} - {topic}\n{second} - {other}\n\n", "{day}\n{name} ({role})\n{second}\n\n"]),
    "contact_block": (["{name}\n{n} Main Street, {place}\nPhone: 555-01{minute}\n\n", "{name}, {role}\nE-mail: desk{n}@example.org\nBranch: {place}; {day} only\n\n"], ["{name}\nRua Direita, {n}, {place}\nTelefone: 555-01{minute}\n\n"]),
    "wrapped_qa": (["What is the state of {topic}\nin {place}?\n{s1},\n{f1}\nand no more.\n\n"], ["Qual é a situação de {topic}\nem {place}?\n{s1},\n{f1}\ne nada mais.\n\n"]),
    "committee": (["COMMITTEE ON {city}\nChair: {name}\nMember: {second}\n{s1}.\n\n", "{n}. Committee\n{name}, chair\n{second}, member\n\n"], ["COMISSÃO {n}\nPresidente: {name}\nMembro: {second}\n{s1}.\n\n"]),
    "table_doc": (["### On {topic}\n\n| place | n | open |\n| --- | --- | --- |\n| {place} | {n} | {flag} |\n| {city} | {amount} | {flag} |\n\n"], ["### Sobre {topic}\n\n| local | n | aberto |\n| --- | --- | --- |\n| {place} | {n} | {flag} |\n| {city} | {amount} | {flag} |\n\n"]),
    "code_doc": (["## call {n}\n\n{s1}.\n\n```\nrun --{word}\n\nend\n```\n\n", "## call {n}\n\n```python\n{word} = {amount}\n\nprint({word})\n```\n\n", "## call {n}\n\n~~~\n{word} {n}\n~~~\n\n"], ["## chamada {n}\n\n{s1}.\n\n```\nrun --{word}\n\nend\n```\n\n"]),
    "bibliography": (["Stone, A. Notes on {topic}. {place}, {year}.\n", "[{n}] Klein, P.; Moss, R. {s1}. {city}: Reed, {year}.\n"], ["Silva, A. Notas sobre {topic}. {place}, {year}.\n"]),
    "csv_block": (["id,topic,place,amount,open\n{n},{topic},{place},{amount},{flag}\n{hour},{other},{city},{minute},{flag}\n\n"], ["id;tema;local;valor\n{n};{topic};{place};{amount}\n{hour};{other};{city};{minute}\n\n"]),
    "bullet_group": (["{place}\n- {topic}\n- {other}\n- {s1}\n\n", "**{place}**\n* {topic}\n* {other}\n\n"], ["{place}\n- {topic}\n- {other}\n- {s1}\n\n"]),
    "single_line": (["{name} asked about {topic} in {place}. {s1}. ", "{s1}; {name} was there. {s2}. "], ["{name} perguntou sobre {topic} em {place}. {s1}. "]),
}
#: A multiple of each kind's number of formats.
FORMATS = 12


def parts_of(template: str) -> list[tuple[str, bool]]:
    """A template's pieces, and whether each is a slot."""
    return [(x, k % 2 == 1) for k, x in enumerate(re.split(r"\{(\w+)\}", template)) if x]


def with_slots(rows: DataFrame, d: Column, u: Column) -> DataFrame:
    """rows with a column _<name> for each slot, in the language of the document."""
    cols = {name: (F.pmod(d * a + u, F.lit(m)) + c).cast("string") for name, (a, m, c) in NUMBERS.items()}
    for name, (held, a, b, c) in POOLS.items():
        of = lambda words: F.get(F.array(*map(F.lit, words)), F.pmod(d * a + u * b + c, F.lit(len(words))).cast("int"))  # noqa: B023, E731
        cols[name] = F.when(F.col("_lang") == 0, of(held[0])).otherwise(of(held[1]))
    return rows.withColumns({f"_{k}": v for k, v in cols.items()})


def filled(template: str) -> Column:
    return F.concat(*(F.col(f"_{x}") if is_slot else F.lit(x) for x, is_slot in parts_of(template)))


def of_kind(formats: tuple[list[str], list[str]]) -> Column:
    by_lang = [F.coalesce(*(F.when(F.pmod("_format", F.lit(len(f))) == k, filled(t)) for k, t in enumerate(f))) for f in formats]
    return F.when(F.col("_lang") == 0, by_lang[0]).otherwise(by_lang[1])


def written(rows: DataFrame, d: Column) -> DataFrame:
    """rows(kind, unit_no, ...) with text and lang; a document's language and format are by its number d."""
    n = len(KINDS)
    rows = rows.withColumns({"_lang": F.pmod(F.floor(d / n), F.lit(2)).cast("int"), "_format": F.pmod(F.floor(d / (2 * n)), F.lit(FORMATS)).cast("int")})
    rows = with_slots(rows, d, F.col("unit_no"))
    text = F.coalesce(*(F.when(F.col("kind") == k, of_kind(f)) for k, f in enumerate(KINDS.values())))
    lang = F.get(F.array(*map(F.lit, LANGS)), F.col("_lang"))
    return rows.withColumns({"text": text, "lang": lang}).drop("_lang", "_format", *(f"_{k}" for k in (*NUMBERS, *POOLS)))


def units_of(ids: DataFrame, seed: int = 0) -> DataFrame:
    """ids(doc_id): (doc_id, kind, unit_no, text, lang), three to six units of one kind, language and format for each id, which
    must not be negative."""
    rows = ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.col("doc_id") + seed, F.lit(len(KINDS))).cast("int").alias("kind"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.pmod("doc_id", F.lit(4)) + 2)).alias("unit_no"))
    return written(rows, F.col("doc_id") + seed)


def corpus(ids: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, text, boundaries, lang, source): a synthetic document for each id; source names its kind."""
    kind = F.get(F.array(*map(F.lit, KINDS)), F.pmod(F.col("doc_id") + seed, F.lit(len(KINDS))).cast("int"))
    return join_units(units_of(ids, seed), F.first("lang").alias("lang")).withColumn("source", kind)


def generate(spark: SparkSession, kind: str, docs: int, units: int = 5, seed: int = 0) -> DataFrame:
    """(doc_id, text, boundaries, lang, source): `docs` documents of `units` units of one kind, in all its languages and formats."""
    rows = spark.range(docs).select(F.col("id").alias("doc_id"), F.lit(list(KINDS).index(kind)).alias("kind"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(units - 1).cast("long"))).alias("unit_no"))
    return join_units(written(rows, (F.col("doc_id") + seed) * len(KINDS)), F.first("lang").alias("lang")).withColumn("source", F.lit(kind))
