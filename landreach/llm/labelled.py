"""Labelled lines to fit a rule list on: of documents made by parts of known kinds, so the label is a fact and not a guess."""

from __future__ import annotations

import base64
import random

NOUNS = "river stone window market engine garden letter bridge winter museum basket copper valley carpet signal harbour kitchen orchard pencil rocket".split()
VERBS = "shows holds brings covers follows changes explains needs keeps finds".split()
ADJECTIVES = "small bright heavy quiet narrow early simple useful broken gentle".split()
#: A few sentences of each language; words in braces are filled in, and the order of words is often changed.
SENTENCES = {
    "en": [
        "The {a} {n} {v} what we had seen in the {m}.", "If it looks {a}, go back to the {m} and try it again!", "Is there a reason to trust the {n}, or should we measure the strengths of both lengths twice?",
        "In 2019 about 45 percent of them were late, which nobody had expected.", "See section 3.2 of the handbook for how we worked this out (it takes a while).", "I don't think that's right; let's ask someone who knows the {n} better than I do.",
    ],
    "de": [
        "Der Wert für {n} ist nicht so {a}, wie wir dachten.", "Durchschnittlich sprachen wir nur selten über die Entwicklungsschritte der Wirtschaft.", "Man könnte schließlich auch sagen, dass nichts zusammenpasst und jetzt alles gleich schwach wirkt.",
        "Es ist nicht klar, warum die Messung schlecht ausfällt, denn der Herbst war schon vorher trocken.", "Danach vergleichen wir das Ergebnis mit dem ersten Versuch und schreiben es auf.", "Wenn das Stück stimmt, muss man die Brücke nicht noch einmal prüfen.",
    ],
    "fr": ["On voit ici que le {n} reste {a}.", "Ensuite, nous allons parler de la mesure pour le {m}, puis dessiner la courbe qui suit.", "Pourquoi l'écart est-il plus grand qu'avant ? Ce n'est pas encore très clair.", "J'ai essayé deux fois et la colonne n'était toujours pas complète, même après l'été."],
    "es": ["Aquí se ve que el {n} es más {a} de lo que esperábamos.", "¿Por qué cambia la {m}? No está claro todavía.", "Ahora vamos a mirar los datos otra vez y después dibujamos la línea de la lluvia.", "Lo probé dos veces y seguía siendo extraño, así que pregunté a alguien más."],
    "pt": ["Não está claro por que o {n} e a {m} não combinam.", "Agora vamos medir tudo de novo, com mais calma.", "Tentei duas vezes e a série continuou estranha, mas a média já era melhor.", "Aqui se vê que o índice é fraco quando falamos da colheita."],
    "sw": ["Hapa tunaona kwamba kipimo ni rahisi.", "Sasa tutalinganisha na sampuli ya kwanza kabla ya kuchora mchoro.", "Kwa nini matokeo hayafanani na yale ya jana? Bado hatujui.", "Nilijaribu mara mbili lakini jedwali halikubadilika hata kidogo."],
    "ru": ["Здесь видно, что выборка вполне простая.", "Дальше мы сравним её с первой и ещё раз подумаем о дожде.", "Если ошибка слишком странная, лучше начать сначала.", "Почему оценка не совпадает с моделью, мы пока не знаем."],
    "ar": ["نرى هنا أن النتيجة ضعيفة.", "سننظر إلى البيانات مرة أخرى ثم نكتب ما وجدناه.", "لماذا تختلف القيمة عن السابق؟ لا نعرف بعد.", "بعد ذلك نقارن المنحنى مع الجدول الأول في القائمة."],
    "hi": ["यहाँ हम देखते हैं कि परिणाम साफ़ है।", "अब हम दूसरा नमूना देखेंगे और फिर उसकी तुलना करेंगे।", "यह मान पहले से कम क्यों है, यह अभी साफ़ नहीं है।", "मैंने दो बार कोशिश की, पर तालिका वैसी ही रही।"],
    "zh": ["接下来画出误差，再和之前的曲线比较。", "为什么结果不一样，目前还不清楚。", "如果样本太小，就先收集更多的数据。", "这里可以看到，平均值比我们想的要低一些。"],
    "ja": ["ここでは結果がまだ安定していません。", "次に別の標本と比べてみましょう。", "なぜ値が前と違うのか、まだ分かりません。", "もう一度測ってから、表に書き直します。"],
}


def _choice(r: random.Random, without: frozenset[str], forms: list[str]) -> str:
    return r.choice([f for f in forms if f not in without] or forms)


def _prose(r: random.Random, without: frozenset[str] = frozenset()) -> str:
    forms = SENTENCES[r.choice([*SENTENCES, "en", "en", "en", "de"])]

    def one() -> str:
        text = r.choice(forms).format(a=r.choice(ADJECTIVES), n=r.choice(NOUNS), v=r.choice(VERBS), m=r.choice(NOUNS))
        words = text[:-1].split()
        if r.random() < 0.5 and len(words) > 2:
            r.shuffle(words)
        return " ".join(words) + text[-1] + ("" if ord(text[-1]) == 0x3002 else " ")

    heads = [f"{'#' * r.randint(1, 3)} {r.choice(NOUNS).title()} {r.choice(['one', 'two', 'of the ' + r.choice(NOUNS)])}", f"{r.choice(NOUNS).title()} of {r.choice(NOUNS)}"]
    text = "".join(one() for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 40]))).strip()
    if r.random() < 0.3:  # wrapped
        out, line = [], ""
        for word in text.split():
            if len(line) + len(word) > 68:
                out, line = [*out, line.strip()], ""
            line += word + " "
        text = "\n".join([*out, line.strip()])
    if r.random() < 0.25:
        text = "\n\n".join([r.choice(heads), text])
    return text


def _code(r: random.Random, without: frozenset[str] = frozenset()) -> str:
    word = lambda: r.choice(NOUNS) if r.random() < 0.7 else f"{r.choice(NOUNS)}_{r.choice(VERBS)}"
    n, m, k = word(), word(), r.randint(1, 99)
    pieces = [
        lambda: f'{n} = {m}.groupby("{word()}")["{m}"].mean().reset_index()',
        lambda: f'assert {n}["{m}"].notna().all(), "gaps"',
        lambda: f"def {r.choice(VERBS)}_{n}({m}, rate={k}):\n    out = {m}.copy()\n    out[\"{n}\"] = out[\"{m}\"].fillna({k})\n    return out",
        lambda: f"for i in range({k}):\n    {n} = scale({m}, i)\n    print(i, len({n}))",
        lambda: f'try:\n    {n} = fit({m})\nexcept ValueError as err:\n    print("{n} failed", err)',
        lambda: f"import {n}_tools as {n}\nfrom {m} import {word()}",
        lambda: f"if {m} > {k}:\n    raise KeyError({n})\nelse:\n    pass",
        lambda: f'Traceback (most recent call last):\n  File "/srv/{n}.py", line {k}, in {m}\n    {n} = {m}[{k}]\nKeyError: \'{n}\'',
        lambda: f'{n}.plot({m}["{word()}"], lw={k / 10}, label="{word()}")\n{n}.set_title("{m} per {word()}")',
        lambda: f"class {n.title()}Box:\n    def __init__(self, {m}={k}):\n        self.{m} = {m}\n\n    def {word()}(self):\n        return self.{m} * {k}",
        lambda: f"%timeit {n}({m})\n!ls {m}/{n}",
        lambda: f"{n}, {m} = {word()}, {k}\n{word()} = sorted({m}, key=lambda v: v[{k}])\nplt.show()",
        lambda: f"---------------------------------------------------------------------------\nTypeError                                 Traceback (most recent call last)\nCell In[{k}], line 2\n      1 {n} = 3\n----> 2 {m}({n})\n\nTypeError: {m} is not callable",
        lambda: f"\x1b[0;31mKeyError\x1b[0m                                 Traceback (most recent call last)\n\x1b[0;32m----> {k}\x1b[0;31m     {n} = {m}.merge({n}, on=\"{m}\")\x1b[0m\n\x1b[0;31mKeyError\x1b[0m: '{n}'",
        lambda: f"SELECT {n}, count(*) FROM {m} WHERE {n} > {k} GROUP BY {n};",
        lambda: f"let {n} = {m}.map((v) => v * {k});\nif ({n}.length) {{\n  console.log({n});\n}}",
    ]
    return "\n".join(r.choice(pieces)() for _ in range(r.randint(1, 5)))


def _items(r: random.Random, many: int) -> list[str]:
    n, m, a = (lambda: r.choice(NOUNS)), (lambda: r.choice(NOUNS)), (lambda: r.choice(ADJECTIVES))
    forms = r.sample([lambda: f"{a()} {n()}", n, lambda: f"{n()} for {m()}", lambda: f"{n()} / {m()}", lambda: f"{n()}: {a()}", lambda: f"{n()} {m()} for {n()} {m()}: {a()}", lambda: f"{n()} {m()} {n()}", lambda: f"{a()} {n()}, {a()}"], r.randint(1, 4))
    return [r.choice(forms)() for _ in range(many)]


def _list(r: random.Random, without: frozenset[str] = frozenset()) -> str:
    many = r.randint(3, 30)
    items = _items(r, many)
    form = _choice(r, without, ["dash", "star", "dot", "bare", "bare", "bare", "nested", "boxes", "numbers", "numbers", "letters", "paths", "pins", "pins", "plus", "bracketed", "foreign"])
    if form == "foreign":
        words = r.choice(["Wert Messung Brücke Fenster Karte", "выборка мост карта окно рынок", "结果 样本 曲线 误差 窗口", "النتيجة السوق الجسر النافذة", "muestra puente mercado ventana"]).split()
        return "\n".join(" ".join(r.sample(words, r.randint(1, 2))) for _ in items)
    if form == "paths":
        return "\n".join(f"{r.choice(['./', '/', '../', ''])}{r.choice(NOUNS)}/{r.choice(NOUNS)}_{i}.{r.choice(['txt', 'csv', 'ipynb'])}" for i in range(many))
    if form == "pins":
        sign = r.choice(["==", "==", ">=", "~="])
        return "\n".join(f"{r.choice(NOUNS)}{r.choice(NOUNS)}{r.choice(['', '-', str(r.randint(1, 99))])}{sign}{r.randint(0, 9)}.{r.randint(0, 30)}" for _ in items)
    marks = {"dash": "- ", "star": "* ", "dot": "• ", "plus": "+ ", "bare": ""}
    if form in marks:
        return "\n".join(marks[form] + x for x in items)
    if form == "nested":
        return "\n".join("  " * r.randint(0, 2) + r.choice("*-") + " " + x for x in items)
    if form == "boxes":
        return "\n".join(r.choice(["[ ] ", "[x] ", "- [ ] "]) + x for x in items)
    if form == "letters":
        return "\n".join(f"{chr(97 + i % 26)}) {x}" for i, x in enumerate(items))
    return "\n".join((f"{i + 1}. " if form == "numbers" else f"({i + 1}) ") + x for i, x in enumerate(items))


def _table(r: random.Random, without: frozenset[str] = frozenset()) -> str:
    k, form = r.randint(2, 7), _choice(r, without, ["pipe", "wide", "wide", "frame", "tab", "comma", "comma", "semicolon", "html", "html", "htmls", "latex", "array", "spaced", "rule"])
    head = r.sample(NOUNS, k)
    number = r.choice([lambda: f"{r.uniform(0, 1000):.2f}", lambda: f"{r.randint(0, 9999)}", lambda: f"{r.gauss(0, 3):.4f}"])
    rows = [[r.choice(NOUNS) if r.random() < 0.8 else str(i), *[number() if r.random() < 0.85 else r.choice(["NaN", "", r.choice(NOUNS)]) for _ in head[1:]]] for i in range(r.randint(3, 25))]
    if form == "array":
        mark = r.choice(["", ","])
        inner = [("[" if i == 0 else " ") + "[" + f"{mark} ".join(f"{r.uniform(-9, 9):{r.choice(['.4e', '.3f', '9.5f'])}}" for _ in range(max(3, k))) + "]" + mark for i in range(len(rows))]
        return "\n".join(inner) + "]"
    if form in ("html", "htmls"):
        cut = r.choice(["\n", "\n  "]) if form == "htmls" else ""
        if r.random() < 0.5:
            body = cut.join(f"<tr>{cut}<th>{i}</th>{cut}" + cut.join(f"<td>{c}</td>" for c in row) + f"{cut}</tr>" for i, row in enumerate(rows * r.randint(1, 4)))
            return f'<div><table border="1" class="dataframe">{cut}<thead><tr style="text-align: right;">{cut}' + cut.join(f"<th>{h}</th>" for h in head) + f"</tr></thead>{cut}<tbody>{cut}{body}{cut}</tbody></table></div>"
        return f"<table>{cut}<tr>" + cut.join(f"<th>{h}</th>" for h in head) + f"</tr>{cut}" + "".join(f"<tr>{cut}" + cut.join(f"<td>{c}</td>" for c in row) + f"</tr>{cut}" for row in rows) + "</table>"
    if form == "wide":
        return "\n".join(f"{i:<4}" + "".join(f"{c:>{r.choice([12, 12, 14])}}" for c in row) for i, row in enumerate([head, *rows]))
    if form == "spaced":
        return "\n".join("   ".join(f"{c:<10}" for c in row) for row in [head, *rows])
    if form == "rule":
        return "\n".join(["  ".join(f"{c:<12}" for c in row) for row in [head, ["-" * 12] * k, *rows]])
    if form == "frame":
        line = "+" + "+".join(["-" * 14] * k) + "+"
        return "\n".join([line, *["|" + "|".join(f"{c:^14}" for c in row) + "|" for row in [head, *rows]], line])
    if form == "pipe":
        return "\n".join("| " + " | ".join(row) + " |" for row in [head, ["---"] * k, *rows])
    sep = {"tab": "\t", "comma": ",", "semicolon": r.choice(["; ", ";"]), "latex": " & "}[form]
    body = "\n".join(sep.join(row) + (" \\\\" if form == "latex" else "") for row in [head, *rows])
    return "\\begin{tabular}{" + "l" * k + "}\n\\hline\n" + body + "\n\\hline\n\\end{tabular}" if form == "latex" else body


def _junk(r: random.Random, without: frozenset[str] = frozenset()) -> str:
    form, n = _choice(r, without, ["base64", "base64", "image", "hex", "percent", "progress", "bars", "log", "steps", "repeat", "noise", "gibberish", "dump", "misread"]), r.randint(100, 1500)
    raw = bytes(r.randrange(256) for _ in range(n))
    text = base64.b64encode(raw).decode()
    if form == "base64":
        return "\n".join(text[i : i + 76] for i in range(0, len(text), 76))
    if form == "image":
        return r.choice([f"![x](data:image/png;base64,{text})", f'<img src="data:image/png;base64,{text}"/>', f'{{"image/png": "{text}"}}', text])
    if form == "hex":
        return r.choice(["".join(f"\\x{b:02x}" for b in raw), raw.hex(), "\n".join(raw[i : i + 32].hex() for i in range(0, n, 32))])
    if form == "percent":
        return "".join(f"%{b:02X}" for b in raw)
    if form == "dump":
        two = r.random() < 0.5
        return "\n".join(f"{i:08x}{r.choice(['', ':'])}  " + (" ".join(raw[j : j + 2].hex() for j in range(i, min(i + 16, n), 2)) if two else " ".join(f"{b:02x}" for b in raw[i : i + 16])) for i in range(0, n, 16))
    if form == "progress":
        name, sep, rest = r.choice(NOUNS), r.choice(":."), r.choice(["s", "<00:12"])
        return r.choice(["\n", "\r", "\n"]).join(f"{name}: {i * 5:3d}%|{'█' * i:<20}| {i}/20 [00{sep}{i:02d}{rest}, {r.uniform(1, 9):.2f}it/s]" for i in range(r.randint(4, 20)))
    if form == "bars":
        return "\n".join(f"[{'=' * i}{'>' * (i < 20)}{'.' * (20 - i)}] - {r.randint(0, 99)}s - loss: {r.random():.4f} - accuracy: {r.random():.4f}" for i in range(r.randint(4, 20)))
    if form == "log":
        return "\n".join(f"2031-0{r.randint(1, 9)}-1{i % 10} 10:28:41{r.choice([',', '.'])}{i:03d} {r.choice(['INFO', 'WARNING', 'DEBUG'])} {r.choice([r.choice(NOUNS), r.choice(NOUNS) + '-' + str(i)])} {r.choice(NOUNS)}.{r.choice(NOUNS)}: {r.choice([r.choice(VERBS) + ' ', ''])}step={i * 31} t={r.random():.5f}" for i in range(r.randint(4, 30)))
    if form == "steps":
        return "\n".join(f"[{r.choice(['INFO', 'debug', 'W'])}] {r.choice(NOUNS)} {i}/{60} {r.choice(VERBS)} {r.random():.3f}s" for i in range(r.randint(4, 30)))
    if form == "repeat":
        line = r.choice(["waiting for the engine ...", "nan nan nan nan nan", "Warning: slow path", "retrying the connection to " + r.choice(NOUNS) + " ...", f"{r.choice(NOUNS)} done in {n}s", f"retry {r.choice(NOUNS)}", "0 0 0 0", _prose(r).split("\n")[0]])
        return "\n".join([line] * r.randint(6, 40))
    if form == "gibberish":
        return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 14))) for _ in range(n // 8))
    if form == "misread":
        clean = " ".join(r.choice(SENTENCES[r.choice(["fr", "ru", "pt", "hi"])]) for _ in range(r.randint(1, 4)))
        return clean.encode().decode("cp1252", "replace") if r.random() < 0.6 else "".join(r.choice(clean.encode().decode("latin-1")) for _ in range(n))
    return "".join(chr(r.randint(33, 126)) if r.random() < 0.9 else r.choice(" \ufffd\x07") for _ in range(n))


PARTS = {"list": _list, "table": _table, "junk": _junk, "prose": _prose, "code": _code}
#: How the cells of a document are set apart.
FRAMES = ["", "", "In [{k}]:\n", "# %%\n", "--- {c} ---\n", "Out[{k}]:\n"]


#: Forms that may be left out of the documents, with their kind.
FORMS = {
    **dict.fromkeys(["dash", "star", "dot", "nested", "boxes", "numbers", "letters", "paths", "pins", "plus", "bracketed", "foreign"], "list"),
    **dict.fromkeys(["pipe", "wide", "frame", "tab", "comma", "semicolon", "html", "htmls", "latex", "array", "spaced", "rule"], "table"),
    **dict.fromkeys(["base64", "image", "hex", "percent", "progress", "bars", "log", "steps", "repeat", "noise", "gibberish", "dump", "misread"], "junk"),
}


def lines(n: int, seed: int = 7, without: frozenset[str] = frozenset()) -> list[tuple[str, list[str]]]:
    """``(text, kind of each line)`` of n documents, for lines that aren't blank; kind is list, table, junk or text."""
    r, out = random.Random(seed), []
    for _ in range(n):
        weights = {k: r.choice([0.3, 1.0, 1.0, 3.0]) for k in PARTS}
        frame = r.choice(FRAMES)
        texts, kinds = [], []
        for k in range(r.randint(1, 12)):
            kind = r.choices(list(weights), list(weights.values()))[0]
            part = PARTS[kind](r, without)
            if frame and r.random() < 0.7:
                texts.append(frame.format(k=k, c="output" if kind in ("table", "junk") else "code").rstrip("\n"))
                kinds.append("text")
                if kind != "code" and frame == "# %%\n":
                    part = "\n".join("# " + x for x in part.split("\n"))
            texts.append(part + "\n" * r.randint(0, 1))
            kinds += [kind if kind in ("list", "table", "junk") else "text"] * sum(1 for x in part.split("\n") if x.strip(" \t\r\x0b\x0c"))
        out.append(("\n".join(texts), kinds))
    return out
