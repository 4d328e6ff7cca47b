"""Labelled spans for the personal-information tagger: invented pieces in carrier sentences, and sentences of the corpus.

Pieces are made by rule from the known names and from invented syllables; carriers are sentences with slots, among them
hard negatives (run numbers, versions, handles, repository addresses). Sentences of the corpus that hold no sign of
personal information serve as text around the carriers.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "id_number", "address", "person")

# fixed values: carrier sentences; slots in braces
CARRIERS = [
    "{P}, who leads the evaluation group, said the numbers would be rerun.", "According to {T} {P}, the pilot ends in May.", "According to {P}, the release was late.", "Signed, {P}", "An earlier draft thanked {P} and {P} for their notes.", "Moderator note: {P} asked us to remove the home address {A} from the thread.", "The leaked form still showed {P}, passport {I}, living at {A}.", "Please ship the cards to {A}, attention {P}.", "Send the parcels to {A}, attention {P}.", "attention {P}.", "living at {A}.", "remove the address {A} from the page.", "Questions can be sent to {P} at {E}.", "To reproduce the run, write to {P} ({E}) or call {F} during office hours.", "Text {F} if the demo box goes down again.", "Contact: {E}, tel. {F}", "The sample prompt contained a taxpayer number, {I}, which nobody had masked.", "My badge number {I} is rejected by the portal, can someone check?", "user_record = {{\"name\": \"{P}\", \"ssn\": \"{I}\", \"tel\": \"{F}\"}}", "row {N};{P};{E};{A};{F}", "The meetup is at {A}, ring twice.", "{F}", "Write to {E} or {E} for access.", "Thanks to {P} for the patch.", "Reviewed by {P} on Monday.", "SSN: {I}. Call {F}.", "{P} (phone {F}) lives at {A}.", "Interview with {P}: the model, {T} {P} says, is ready.", "From: {P} <{E}>", "Mr {P} and Ms {P} signed it.", "{P} wrote: please reply to {E}.", "Ship to {P}, {A}.", "An email from {E} arrived at noon.",
    "Frau {P} leitet die Gruppe seit März.", "Herr {P} war nicht dabei.", "Die Unterlagen gehen an {P}, {A}.", "Treffpunkt ist {A}, bitte klingeln.", "Im Datensatz stand noch die Steuernummer {I} von {P}.", "Fragen beantwortet {P} unter {E} oder telefonisch unter {F}.", "Kontakt: {E}, Tel. {F}", "Laut {P} endet der Test im Mai.",
    "Selon {P}, le pilote prendra fin en mai.", "Le dossier mentionnait encore {P}, domicile {A}.", "Pour toute question, écrivez à {P} ({E}) ou appelez le {F}.", "Le numéro de sécurité sociale {I} figurait dans l’exemple.", "M. {P} et Mme {P} ont signé.", "Contact : {E}, tél. {F}",
    "Según {P}, el piloto termina en mayo.", "El formulario aún mostraba a {P}, con domicilio en {A}.", "Para cualquier duda, escriba a {P} ({E}) o llame al {F}.", "Contacto: {E}, tel. {F}", "El DNI {I} seguía en la muestra.", "La muestra contenía el documento {I} de {P}.",
    "Segundo {P}, o piloto termina em maio.", "Dúvidas podem ser enviadas a {P} pelo endereço {E} ou pelo telefone {F}.", "O CPF {I} ainda estava na amostra.", "A amostra trazia {P}, residente na {A}.",
    "样本中仍保留了{C}的身份证号{I}。", "请拨打{F}预约演示。", "联系邮箱 {E}，电话 {F}。", "据{C}介绍，试点将在五月结束。", "{C}表示，结果需要复核。", "资料请寄往{A}，{C}收。", "{C}和{C}参与了评审。", "如有疑问请联系{C}（{E}）。",
    "收件地址：{A}，收件人{C}。", "收件地址：{A}，收件人{C}。", "收件人{C}，地址{A}。", "收货地址：{A}，收货人{C}。", "邮寄地址：{A}。", "{A}，{C}收。", "样品寄到{A}，请{C}签收。", "收件地址：{A}，联系人{C}，电话{F}。", "寄送地址为{A}，由{C}签收。", "联系人{C}，电话{F}。", "负责人{C}表示，数据将重新测试。", "如有疑问，请联系{C}，邮箱 {E}，电话 {F}。", "如有疑问，请联系{C}，邮箱 {E}，电话 {F}。", "{C}住在{A}。", "表格里写着{C}，证件号{I}。", "身份证{I}属于{C}。", "由{C}审核，{C}复核。", "地址：{A}。", "致电{F}，找{C}。", "邮件请发至{E}，抄送{C}。",
    "El documento de identidad {I} aparecía sin ocultar.", "El documento de identidad {I} aparecía en la muestra.", "Su documento de identidad, {I}, quedó a la vista.", "El documento de identidad {I} figuraba en el archivo.", "Documento de identidad: {I}.", "El documento {I} es de {P}.", "La cédula {I} no se ocultó.", "Con DNI {I}, {P} firmó el acta.", "El NIE {I} no estaba oculto.", "Envíen las tarjetas a {A}, a la atención de {P}.", "Vive en {A}.", "Dirección: {A}.", "Su casa está en {A}.", "Firmado: {P}", "Nota: {P} pidió borrar el domicilio {A}.", "{P} (tel. {F}) vive en {A}.",
    "O documento {I} de {P} ainda estava no registro.", "O bilhete de identidade {I} não foi ocultado.", "Envie os cartões para {A}, aos cuidados de {P}.", "Assinado: {P}", "Mora na {A}.", "Ligue para {F} e fale com {P}.", "Contato: {E}, tel. {F}",
    "Le document d’identité {I} restait visible.", "Merci d’envoyer les cartes au {A}, à l’attention de {P}.", "Elle habite {A}.", "Le dossier mentionnait {P}, demeurant {A}.", "Il vit {A}.", "Son domicile, {A}, a été publié.", "Adresse : {A}.", "Contact : {E} – {F}", "Appelez {P} au {F}.", "Signé : {P}", "Mme {P} dirige l’équipe depuis mars.", "La carte d’identité {I} de {P} était lisible.", "Rendez-vous au {A}, sonnez deux fois.",
    "Die Ausweisnummer {I} war nicht geschwärzt.", "Bitte schicken Sie die Karten an {A}, zu Händen von {P}.", "Wohnhaft in {A}.", "Anschrift: {A}.", "Das Paket ging an {A}.", "Gezeichnet, {P}", "Rufen Sie {P} unter {F} an.", "Der Personalausweis {I} lag offen.", "{P} bat darum, die Anschrift {A} zu löschen.", "Tel. {F}",
    "-- \n{P}\n{E}\n{F}", "-- \n{P}\n{E}\n{F}", "Regards,\n{P}\n{F}", "Cheers, {P}", "contact: {E} / {F}", "contact: {E} / {F}", "reported-by: {E}", "cc: {P} <{E}>", "{P} | {F} | {E}", "row {N};{P};{E};{A};{F}", "Moderator note: {P} asked us to remove the home address {A}.", "Questions about the plan can be sent to {P} at {E}.", "Please ship the kits to {A}, attention {P}.", "{P} still appeared with passport {I}, living at {A}.", "Call {F} and ask for {P}.", "The parcel for {P} went to {A} by mistake.", "The form listed {P}, born 1984, of {A}.", "{P} and {P} signed the letter; {T} {P} did not.", "Driver licence {I} was in plain sight.", "National ID {I}, phone {F}.", "{T} {P} disagreed.", "Her number is {F}, his is {F}.", "The invoice went to {P}, {A}.", "Ask {P} or {P} before the freeze.", "name={P}&phone={F}", "Reach me at {F} or {E}.", "or call {F} during the day.",
    "連絡先は{J}さん、電話は{F}です。", "{J}氏によると、五月に終わる。", "住所は{A}です。", "身分証番号{I}が残っていた。", "担当の{J}さん（{E}）まで。",
    "お問い合わせは {E} または電話 {F} まで。", "記録には番号 {I} がそのまま残っていた。", "資料は{A}まで送ってください。", "{J}さんは、結果を確認中だと述べた。",
]
NEGATIVE = [
    "See run {R} and commit {H} for the raw scores.", "The server 10.0.0.{N}:8443 answered in {N} ms; ticket INC-{N}-44-1208 is closed.", "Timestamps such as 2024-05-17 10:{N}:33 are kept as they are.", "The Elm Street split holds 5,550,{N} frames, not 5551{N}.", "Ping @{U}_bot in the channel, or clone git@code.relay.test:lab/tool.git.", "Install it with `npm add {W}@2.1.{N}`.", "Road to {N} billion tokens: 54 layers, {N} heads, lr 3e-4.", "Order {R} ships with build {N}.{N}.{N}.{N}.", "Part number {W}-{N}-{N} is out of stock, version {N}.{N}.", "La tâche {R} a duré 55501{N} millisecondes.", "Lauf {R} dauerte 55501{N} Millisekunden.", "La tarea {R} tardó 55501{N} milisegundos.", "A tarefa {R} levou 55501{N} milissegundos.", "编号 2024-{N}-8817 的任务耗时 5550{N} 毫秒。", "処理番号 {R} は 55501{N} ミリ秒かかった。", "Die Straße der Tests ist lang, sagt der Bericht auf Seite {N}.", "{W} Labs and {W} {O} merged their datasets.", "Engineers at {W} {O} rebuilt the queue.", "{W} says {W} {W} handled {N} requests per minute.", "A memo from {W} {O} asked for slower releases.", "{W} {N}.{N} ships with half the memory.", "一次关于代码修复的审计发现了{N}行未标注数据。", "{W}与{W}团队合并了数据集。", "Selon {W} {O}, {W} traite {N} requêtes par minute.", "Según {W} {O}, {W} atiende {N} peticiones por minuto.", "{W} {O} zufolge bewältigt {W} rund {N} Anfragen.", "The {W} team published {N} traces of cache reuse.", "With {W} switched off, an audit of tuning found {N} rows.", "The score moved from {N} to {N}, and the bill rose by {N}.5%.", "Follow @{U} and @{U} for news.", "port {N}, pid {N}, 0x{H}", "Release {W} {W} {N}.{N} is planned for 2024-0{D}-1{D}.",
]
# fixed values: titles, organisation words, name characters, street words
TITLES = ["Dr.", "Prof.", "Mr", "Ms", "Mrs.", "Dr"]
ORG = ["Labs", "Research", "Institute", "Systems", "Works", "AI", "Group", "GmbH", "Inc"]
GIVEN_SIGNS, FAMILY_SIGNS = "云远知松澄映禾棠岑川微笛舟伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚", "麓汀屿岚笙榆砚王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗"
PLACE_SIGNS = "青云石松溪桥泽岭秋知望舒听雨涛中山东西南北新华长安和平江海城建设文化人民解放光明胜利金湖花园"
EN_STREET = ["Street", "St", "St.", "Road", "Rd.", "Rd", "Avenue", "Ave", "Lane", "Close", "Terrace", "Drive", "Way", "Court"]
JA_FAMILY = ["佐藤", "鈴木", "高橋", "田中", "伊藤", "渡辺", "山本", "中村", "小林", "加藤"]
_SIGN = re.compile(
    r"收件|收货|地址|号\d+[栋室]|\d+号|负责人|联系|保留|编号|\d{6,}|\d{3}[-. ]\d{4}|\d{2}[. ]\d{2}[. ]\d{2}|documento|identi|document d|\b[A-Z]\. [A-Z]|\breported|\bcontact|;\S*;|\"name\"|^-- |\bresiden|ausweis|\bgezeichnet|\bfirmad|\bassinad|\bshipped? |[@＠]|\(at\)|\[at\]|\bAT\b|\bat \w+ (?:dot|DOT)|\d[\d ().-]{7,}\d|\b(?:passport|ssn|badge|taxpayer|address|tel|call|phone|living|domicil|email|mail|contact|signed|thanked|attention|moderator|meetup|row|"
    r"steuer|frau|herr|unterlagen|treffpunkt|fragen|selon|dossier|sécurité|écrivez|según|formulario|escriba|dúvidas|segundo)\b|身份证|电话|邮|请|联系|番号|問い合わせ|介绍|表示",
    re.I,
)


class Maker:
    """Invented pieces, from a seeded generator and the known names."""

    def __init__(self, given: list[str], family: list[str], seed: int) -> None:
        self.r = random.Random(seed)
        self.given = given or ["Anna", "Peter", "Maria", "Ivan"]
        self.family = family or ["Miller", "Novak", "Santos", "Keller"]
        self.ends = sorted({f[-4:] for f in self.family if len(f) > 6}) or ["son", "berg"]

    def syllables(self, n: int) -> str:
        return "".join(self.r.choice("b br d f g k l m n p r s t tr v z".split()) + self.r.choice("aeiou") for _ in range(n))

    def word(self) -> str:
        return self.syllables(self.r.choice([2, 2, 3])).capitalize()

    def one_given(self) -> str:
        return self.r.choice(self.given) if self.r.random() < 0.6 else self.syllables(self.r.choice([2, 2, 3])).capitalize()

    def one_family(self) -> str:
        x = self.r.random()
        return self.r.choice(self.family) if x < 0.55 else (self.syllables(self.r.choice([2, 3])) + self.r.choice(self.ends)).capitalize() if x < 0.9 else self.syllables(3).capitalize()

    def P(self) -> str:
        g, f, x = self.one_given(), self.one_family(), self.r.random()
        s = f"{g} {f}" if x < 0.55 else f"{f}, {g}" if x < 0.67 else f"{g}-{self.one_given()} {f}" if x < 0.76 else f"{g[0]}. {f}" if x < 0.84 else f"{g} {self.r.choice('ABCDEFGKLMNPRST')}. {f}" if x < 0.92 else f"{g} {f[0]}."
        return s.upper() if self.r.random() < 0.06 else s

    def C(self) -> str:
        return self.r.choice(FAMILY_SIGNS) + "".join(self.r.choice(GIVEN_SIGNS) for _ in range(self.r.choice([1, 2, 2, 2])))

    def J(self) -> str:
        return self.r.choice(JA_FAMILY) + (self.r.choice(["", "健一", "美咲", "翔"]))

    def digits(self, shape: str) -> str:
        return "".join(self.r.choice("0123456789") if c == "9" else self.r.choice("ABCDEFGHJKLMNPQRSTVWXYZ") if c == "?" else c for c in shape)

    def F(self) -> str:
        return self.digits(self.r.choice(["(999) 555-0999", "999-555-0999", "999.999.0999", "999-0999", "+99 99 99 99 99 99", "99 99 99 99 99", "99.99.99.99.99", "999 999 999", "0999-99-99999-999", "(099) 99999-999", "099 99999 999", "+19995550999", "+1 999 555 0999", "999.555.0999", "+44 20 7999 0999", "020 7999 0999", "555-0999", "+49 30 99999999", "(030) 99999-999", "030 99999999", "0199009999", "01 99 00 99 99", "01.99.00.99.99", "09 99 99 99 99", "+33 1 99 00 99 99", "+33 9 99 99 99 99", "900 555 999", "900-555-999", "900555999", "999-999-999", "+34 900 555 999", "(11) 95559-9999", "+55 11 95559 9999", "199-0000-9999", "+86 199 0000 9999", "010-99999999", "19900009999", "+81 3 5559 9999", "03-5559-9999", "+999 99 999 9999", "0049 30 999999", "0049-30-99999999", "030 99999 999", "+49-30-99999999", "+442079460999", "02079460999"]))

    def I(self) -> str:  # noqa: E743
        return self.digits(self.r.choice(["999-99-9999", "999-99-9999", "999 99 9999", "999999999", "?99999999", "?99999999", "99 999 999 999", "99999999999", "9 99 99 99 999 999 99", "999999999999999", "99999999?", "99999999-?", "99999999?", "99999999-?", "?9999999-?", "?9999999?", "99.999.999-9", "999.999.999-99", "990999199999999999", "99999919999999999X", "??999999?", "?9999999", "999999-999?"]))

    def E(self) -> str:
        g, f = self.syllables(self.r.choice([2, 3])), (self.r.choice(self.family) if self.r.random() < 0.5 else self.syllables(3)).lower()
        n = self.r.choice(["", "", str(self.r.randrange(1, 999))])
        user = self.r.choice([f"{g}.{f}{n}", f"{g}_{f}{n}", f"{f}+evals", f"info-{f}", f"{g[0]}{f}", f"{g}{n}", f"{f}{n}"])
        host, top = self.r.choice(["mailbox", "post", "inbox", "lab", "mail", self.syllables(2)]), self.r.choice(["example", "test", "invalid", "co.example", "com", "org"])
        x = self.r.random()
        out = f"{user}@{host}.{top}" if x < 0.6 else f"{user}＠{host}.{top}" if x < 0.66 else f"{user} AT {host} DOT {top.replace('.', ' DOT ')}" if x < 0.74 else f"{user} (at) {host} (dot) {top.replace('.', ' (dot) ')}" if x < 0.82 else f"{user}[at]{host}.{top}" if x < 0.88 else f"{user} at {host} dot {top}" if x < 0.94 else f"{user} @ {host}.{top}"
        return out.upper() if self.r.random() < 0.05 else out

    def A(self) -> str:
        r, w, n = self.r, self.word(), self.r.randrange(1, 180)
        zip5 = self.digits("99999")
        town = self.word()
        x = r.random()
        if x < 0.45:
            out = f"{n} {w} {r.choice(EN_STREET)}"
            out += r.choice(["", "", f", Apt {r.randrange(1, 30)}", f", Unit {r.choice('ABCDEF')}", f", Suite {r.randrange(1, 40)}"])
            return out + r.choice(["", f", {town}", f", {town}ford {zip5}", f", {town}ton", f", {town} {zip5}"])
        if x < 0.57:
            return f"{w}{r.choice(['straße', 'weg', 'platz', 'allee', 'gasse', 'str.'])} {n}{r.choice(['', 'a', 'b'])}, {zip5} {town}{r.choice(['bruck', 'stadt', ''])}"
        if x < 0.68:
            return f"{n}{r.choice(['', ' bis', ' ter', ',', ','])} {r.choice(['rue', 'avenue', 'allée', 'boulevard', 'impasse'])} {r.choice(['de ', 'du ', 'des ', ''])}{w}, {zip5} {town}ville"
        if x < 0.79:
            return f"{r.choice(['Calle', 'Avenida', 'Paseo', 'Plaza', 'Rua', 'Travessa'])} {r.choice(['de ', 'del ', ''])}{w} {n}{r.choice(['', f', {r.randrange(1, 9)}.º {r.choice('ABCD')}'])}, {zip5} {town}"
        if x < 0.97:
            s = r.choice
            z = lambda: s(PLACE_SIGNS) + s(PLACE_SIGNS)
            return f"{s(['', '', z() + '市'])}{s(['', z() + '区', z() + '区', z() + '区'])}{z()}{s(['路', '街', '大道', '巷'])}{n}号{s(['', f'{r.randrange(1, 30)}室', f'{r.randrange(1, 29)}栋{r.randrange(1, 600)}室'])}"
        return f"{r.choice(['東京都', '大阪府'])}{r.choice(['港区', '北区', '中央区'])}{r.choice(['青山', '本町', '芝'])}{r.randrange(1, 9)}-{r.randrange(1, 20)}-{r.randrange(1, 20)}"

    def carrier(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """A carrier with its slots filled, and the labelled spans (start, end, kind)."""
        out, spans = "", []
        for part in re.split(r"(\{[A-Z]\})", text):
            if not re.fullmatch(r"\{[A-Z]\}", part):
                out += part.replace("{{", "{").replace("}}", "}")
                continue
            k = part[1]
            kind = {"P": "person", "C": "person", "J": "person", "E": "email", "F": "phone", "I": "id_number", "A": "address"}.get(k)
            value = getattr(self, k)() if kind else {"T": lambda: self.r.choice(TITLES), "N": lambda: str(self.r.randrange(2, 1900)), "R": lambda: f"8841-{self.r.randrange(2, 999)}-2207" if self.r.random() < 0.5 else self.digits("9999-99-9999"), "H": lambda: "".join(self.r.choice("0123456789abcdef") for _ in range(11)), "U": lambda: self.word(), "W": lambda: self.word(), "O": lambda: self.r.choice(ORG), "D": lambda: str(self.r.randrange(1, 9))}[k]()
            if kind:
                spans.append((len(out), len(out) + len(value), kind))
            out += value
        return out, spans


def labelled(given: list[str], family: list[str], corpus: list[str], size: int, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``size`` labelled texts: a carrier, or a negative, with sentences of the corpus before and after."""
    make = Maker(given, family, seed)
    r = make.r
    calm = [s for t in corpus for s in re.split(r"\n|(?<=[.!?])\s+|(?<=。)", t) if 8 < len(s) < 160 and not _SIGN.search(s)] or ["The report lists failures."]
    known = set(given) | set(family)
    ends = tuple(make.ends)
    # sentences that may name somebody would teach the tagger to leave names alone
    calm = [s for s in calm if not any(w in known or w[:1].isupper() and len(w) > 6 and w.endswith(ends) for w in re.findall(r"\w+", s))] or calm
    out = []
    for i in range(size):
        x = r.random()
        text, spans = make.carrier(r.choice(CARRIERS)) if x < 0.55 else make.carrier(r.choice(NEGATIVE)) if x < 0.75 else (r.choice(calm), [])
        if r.random() < 0.75:
            before = "".join(r.choice(calm) + r.choice([" ", "\n", " "]) for _ in range(r.choice([1, 1, 2])))[-r.choice([40, 90, 140]) :]
            text, spans = before + text, [(a + len(before), b + len(before), k) for a, b, k in spans]
        if r.random() < 0.3:
            more, at = make.carrier(r.choice(CARRIERS))
            text += r.choice([" ", "\n"])
            spans += [(a + len(text), b + len(text), k) for a, b, k in at]
            text += more
        if r.random() < 0.65:
            text += r.choice([" ", "\n"]) + r.choice(calm)[: r.choice([40, 120])]
        out.append((text, spans))
    return out
