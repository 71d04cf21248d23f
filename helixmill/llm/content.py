"""Scoring documents for abusive, hateful or sexual content by nearest labelled examples.

Labels say something about whole documents; what counts is in single passages. So every
passage of a labelled document is an example, and a document's label is shared out among its
passages: those that other positive documents or the seed examples back take it whole; where none is backed, the
passages that no harmless document has share it between them. Each distinct passage of the
corpus is then compared with the examples by exact TF-IDF cosine (over hashed features), its nearest ones vote with
the fifth power of their cosine, and the votes are turned into probabilities by a logistic
curve fitted on labelled documents, each without the examples that only it has. A
document's score is that of its worst passage, with the nearest example as evidence.

The curve's middle stays between votes of ``MIDDLE`` and it is never flatter than ``LEAST_SLOPE``,
however few labels there are, so a passage whose neighbours all are positive scores 0.9 or more.

Document frequencies cover every passage of every document. Bounded are only the labelled
documents (``MOST_LABELLED``) and examples (``MOST_EXAMPLES``) that the index is fitted on.
Texts are split once; equal passages are scored once, whatever part of the documents holds them; only passages with
a positive vote are joined back.

Defined cases: NULL, empty and letterless texts score 0; a document without a
label is as good as any; annotators who disagree share the label; labels of
unknown documents or categories are ignored; without labels the seed examples decide
alone; texts of any length are read whole; repeated documents score alike; further columns are ignored.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm import passages
from helixmill.llm.neighbours import BlockMaxIndex
from helixmill.session import durable

CATEGORIES = ["abusive", "hateful", "sexual"]
#: Bounds of what the index is fitted on.
MOST_LABELLED = 20_000
MOST_EXAMPLES = 40_000
MOST_HELD_OUT = 300
NEAREST = 10
POWER = 5
#: A vote no neighbour casts: keeps passages that resemble nothing from scoring high.
NO_VOTE = 0.25**POWER
#: The same where labels are shared out: what backs a label must be rather alike.
NO_BACKING = 0.3**POWER
#: Cosine from which examples say the same, and the clean documents that make a passage harmless.
ALIKE = 0.6
SEVERAL = 3
#: Rounds in which labels are shared out, the vote that backs a passage, and what one without any vote weighs.
ROUNDS = 3
BACKED = 0.5
UNBACKED_WEIGHT = 0.05
THRESHOLD = 0.5
#: Bounds of the curve: where its middle may lie, and its least slope.
MIDDLE = (0.3, 0.7)
LEAST_SLOPE = 8.0

# Example passages that stand beside the labelled ones, by category.
SEEDS: dict[str, list[str]] = {
    "none": [
        "I was so stupid to forget this.", "My own dumb mistake, sorry.", "I am such an idiot, I mixed up the files.", "I feel like a failure today.", "This stupid printer is broken again.", "The damn software crashed, what a useless tool.",
        "This is a terrible protocol and a waste of time.", "An abusive message was reported and removed.", "The complaint about harassment was passed on.", "Insults were heard in the waiting room.", "The comment was deleted because of hate speech.",
        "The patient was examined for breast cancer.", "Penile, vaginal and anal swabs were taken.", "Sexual function and sexual history were recorded.", "Sexually transmitted infections were tested.", "Naked eye inspection showed no change.",
        "Rats and mice were kept in cages.", "Parasites were found in the blood of animals.", "Foreign patients need an interpreter.", "Women and older people were enrolled as well.", "Kill the process and strip the header.", "The male and female connectors do not fit.", "This model is too dumb to learn the pattern.",
        "Quelle erreur stupide de ma part.", "Cette machine idiote est encore en panne.", "Un message injurieux a été signalé.", "Les patientes étrangères ont été incluses.", "Le cancer du sein a été traité.",
        "Das war ein dummer Fehler von mir.", "Dieser blöde Drucker ist schon wieder kaputt.", "Eine beleidigende Nachricht wurde gemeldet.", "Ausländische Patienten wurden aufgenommen.", "Die Brust wurde untersucht.",
        "Qué error tan tonto el mío.", "Esta estúpida máquina no funciona.", "Se denunció un mensaje ofensivo.", "Los pacientes extranjeros fueron incluidos.", "Se trató el cáncer de mama.",
    ],
    "abusive": [
        "You are a stupid idiot.", "You worthless piece of trash.", "What a pathetic moron you are.", "Shut up, you dumb loser.", "Everyone here thinks you are an incompetent fool.",
        "You are too stupid to do this job.", "He is a complete imbecile and a waste of space.", "Go kill yourself.", "I will find you and hurt you.", "I know where you live, watch your back.",
        "Nobody likes you, you disgusting pig.", "You make me sick, you little rat.", "Fuck you, asshole.", "Get lost, you useless bastard.", "I am going to break your neck.", "You deserve to be beaten.",
        "You have no brain at all, you brainless clown.", "Do us all a favour and disappear, nobody will miss you.", "You should be ashamed of yourself, you cannot be trusted with anything.", "I will knock your teeth out.",
        "Even a dog is smarter than you and smells better.", "The best thing you can do for us is to quit.",
        "Tu es un imbécile.", "Ferme ta gueule, espèce de connard.", "Va te faire foutre, salope.", "Je vais te tuer.", "Personne ne t'aime, pauvre minable.", "Quel abruti, il est trop bête pour ce travail.",
        "Disparais, tu ne manqueras à personne.", "Je vais te casser la gueule.", "Vous êtes une bande d'incapables.",
        "Du bist ein Idiot.", "Halt die Fresse, du Arschloch.", "Ich bringe dich um.", "Du bist zu dumm für diese Arbeit, du Versager.", "Verpiss dich, du Miststück.",
        "Verschwinde, niemand wird dich vermissen.", "Ich schlage dir in die Fresse.", "Ihr seid alle unfähige Trottel.",
        "Eres un idiota.", "Cállate, imbécil de mierda.", "Te voy a matar.", "Vete a la mierda, hijo de puta.", "Eres demasiado estúpido para este trabajo, inútil.",
        "Desaparece, nadie te va a echar de menos.", "Te voy a romper la cara.", "Sois una panda de inútiles.",
    ],
    "hateful": [
        "Those people are vermin and should be kept out of our country.", "Immigrants are parasites and breed like rats.", "Women are too stupid for science.", "All of them are animals and belong in a cage.",
        "Disabled people are a burden and should not be treated.", "I refuse to work with that dirty race.", "They do not deserve to live among us.", "Send them all back where they came from.", "Their kind is inferior to us.", "Gays are sick and should be locked away.",
        "The world would be a better place without foreigners.", "These people do not deserve to be treated, let them die.", "They all steal, lock everything away when one of them comes near.",
        "Les étrangers sont des parasites qu'il faut chasser.", "Ces gens sont des animaux.", "Les femmes sont trop bêtes pour la science.", "Ces gens sont sales et ne méritent pas d'être soignés.", "Il faudrait interdire l'hôpital aux immigrés.",
        "Ausländer sind Ungeziefer und gehören nicht hierher.", "Diese Leute sind Tiere.", "Frauen sind zu dumm für die Wissenschaft.", "Für solche Leute ist jede Behandlung verschwendet.",
        "Los extranjeros son parásitos y hay que echarlos.", "Esa gente son animales.", "Las mujeres son demasiado tontas para la ciencia.", "Esa gente no merece que la curen.",
    ],
    "sexual": [
        "I want to fuck you.", "Send me nude pictures of you.", "Your tits look great.", "Take off your clothes and get on your knees.", "I would love to lick your body all over.", "She sucked his cock.",
        "Free porn videos of horny girls, click here.", "I keep thinking of you naked in my bed.", "He came inside her while she moaned.", "Sit on my lap and touch me.",
        "I touched myself all night thinking of you.", "You make me wet.", "Tell me what you are wearing and take it off slowly.",
        "J'ai envie de te baiser.", "Envoie-moi des photos de toi nue.", "Tes seins me rendent fou.", "Déshabille-toi et viens dans mon lit.",
        "Ich will dich ficken.", "Schick mir Nacktfotos von dir.", "Deine Titten sind geil.", "Zieh dich aus und komm in mein Bett.",
        "Quiero follarte.", "Mándame fotos desnuda.", "Tienes unas tetas increíbles.", "Quítate la ropa y ven a mi cama.",
    ],
}


@dataclass
class Model:
    """The index and, per example, the share of each category, the document it is from and its words."""

    index: BlockMaxIndex
    shares: np.ndarray
    doc_ids: np.ndarray
    texts: list[str]
    slope: float = 10.0
    offset: float = -5.0

    def vote(self, ids: np.ndarray, sims: np.ndarray, blank: float = NO_VOTE) -> np.ndarray:
        """Vote per category of the examples ``ids`` at cosines ``sims``."""
        weight = sims.astype(np.float64) ** POWER
        return weight @ self.shares[ids] / (weight.sum() + blank) if len(ids) else np.zeros(len(CATEGORIES))

    def judge(self, ids: np.ndarray, sims: np.ndarray) -> tuple[float, str, int | None, str, float] | None:
        """Score, category and evidence (document, words, cosine); nothing where no example is positive."""
        votes = self.vote(ids, sims)
        if votes.sum() <= 0:
            return None
        best = int(np.flatnonzero(self.shares[ids].sum(axis=1) > 0)[0])
        doc = int(self.doc_ids[ids[best]])
        return self.probability(float(votes.sum())), CATEGORIES[int(votes.argmax())], doc if doc >= 0 else None, self.texts[ids[best]], float(sims[best])

    def probability(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * vote + self.offset)))) if vote > 0 else 0.0


def split_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, passages): the only time that texts are read."""
    return docs.select("doc_id", passages.passages(F.col("text")).alias("passages"))


def corpus_passages(split: DataFrame) -> DataFrame:
    """(k1, k2, passage, n_docs): the distinct passages of all documents."""
    exploded = split.select(F.explode("passages").alias("passage"))
    return exploded.groupBy("passage").agg(F.count(F.lit(1)).alias("n_docs")).select(*_keys("passage"), "passage", "n_docs")


def _keys(column: str) -> list:
    return [F.xxhash64(column).alias("k1"), F.xxhash64(F.lit(1), column).alias("k2")]


def with_features(distinct: DataFrame) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["features"] = [passages.features(p) for p in pdf["passage"]]
            yield pdf

    return distinct.mapInPandas(work, "k1 long, k2 long, passage string, n_docs long, features array<int>")


def inverse_frequencies(featured: DataFrame) -> np.ndarray:
    """idf of every hashed feature over all passages of all documents; ``DIM`` numbers."""
    held = featured.select("n_docs", F.explode(F.array_distinct("features")).alias("f")).groupBy("f").agg(F.sum("n_docs").alias("df")).toPandas()
    total = featured.agg(F.sum("n_docs")).first()[0] or 0
    df = np.zeros(passages.DIM)
    df[held["f"].to_numpy(dtype=np.int64)] = held["df"].to_numpy(dtype=np.float64)
    return (np.log((total + 1) / (df + 1)) + 1).astype(np.float32)


def labelled_documents(split: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, passages, none and each category's share of the readings, their number), at most ``most`` documents."""
    known = labels.filter(F.col("category").isin("none", *CATEGORIES) & F.col("doc_id").isNotNull())
    per = known.groupBy("doc_id").agg(*[F.avg((F.col("category") == c).cast("double")).alias(c) for c in ["none", *CATEGORIES]], F.count(F.lit(1)).alias("n_readings"))
    few = per.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most MOST_LABELLED rows of numbers, so broadcasting them is safe
    return split.join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "passages", "none", *CATEGORIES, "n_readings")


def example_passages(labelled: DataFrame, most: int = MOST_EXAMPLES) -> pd.DataFrame:
    """Distinct passages with summed label shares, their first document and all positive ones; positives come first."""
    sums = labelled.select("doc_id", "none", *CATEGORIES, F.explode("passages").alias("passage")).groupBy("passage").agg(
        *[F.sum(c).alias(c) for c in ["none", *CATEGORIES]], F.min("doc_id").alias("doc_id"), F.collect_set(F.when(F.col("none") < 1, F.col("doc_id"))).alias("positive_docs")
    )
    return sums.orderBy(F.col("none") / (sum(F.col(c) for c in CATEGORIES) + F.col("none")), F.desc(sum(F.col(c) for c in CATEGORIES) + F.col("none")), "passage").limit(most).toPandas()


@dataclass
class Examples:
    """A model with what the labels of its examples rest on."""

    model: Model
    rows: list[list[int]]
    total: np.ndarray
    by_plain: dict[str, int]


def build(examples: pd.DataFrame, idf: np.ndarray, positive: pd.DataFrame, seeds: Mapping[str, Sequence[str]] = SEEDS) -> Examples:
    """The index over ``examples`` and ``seeds``, with the labels of the ``positive`` documents shared out.

    ``positive`` is (doc_id, the share of its readings per category, worth): worth is how probably it is a case.
    """
    # what is the same once disguises are undone is one example with all its labels
    examples = examples.assign(plain=[passages.plain(p) for p in examples["passage"]]).sort_values(["plain", "passage"])
    grouped = examples.groupby("plain", sort=True)
    merged = grouped.agg({"passage": "first", "none": "sum", **dict.fromkeys(CATEGORIES, "sum"), "doc_id": "min"}).reset_index()
    merged["docs"] = [sorted({int(d) for ds in part for d in ds}) for _, part in grouped["positive_docs"]] if len(merged) else []
    listed = [(c, s) for c in ["none", *CATEGORIES] for s in seeds.get(c, [])]
    texts = merged["passage"].tolist() + [s for _, s in listed]
    plain = merged["plain"].tolist() + [passages.plain(s) for _, s in listed]
    labels = merged[["none", *CATEGORIES]].to_numpy(dtype=float).reshape(-1, 1 + len(CATEGORIES))
    labels = np.vstack([labels, [[float(c == k) for k in ["none", *CATEGORIES]] for c, _ in listed]]) if listed else labels
    doc_ids = np.concatenate([merged["doc_id"].to_numpy(dtype=np.int64), np.full(len(listed), -1, dtype=np.int64)])
    held_by = merged["docs"].tolist() + [[] for _ in listed]
    total = np.maximum(labels.sum(axis=1), 1e-9)
    shares = labels[:, 1:] / total[:, None]
    # like beside like: blocks of related passages have tight bounds
    order = sorted(range(len(texts)), key=lambda i: (-shares[i].sum(), plain[i]))
    texts, doc_ids, total, labels, held_by = [texts[i] for i in order], doc_ids[order], total[order], labels[order], [held_by[i] for i in order]
    rows = [passages.features(t) for t in texts]
    model = Model(BlockMaxIndex(rows, idf), shares[order], doc_ids, texts)
    made = Examples(model, rows, total, {plain[i]: n for n, i in enumerate(order)})
    _share_out(made, labels, held_by, positive)
    return made


def _share_out(made: Examples, labels: np.ndarray, held_by: list[list[int]], positive: pd.DataFrame) -> None:
    """Share the label of every positive document out among its passages, then mend labels of clean ones."""
    model, total = made.model, made.total
    seed = model.doc_ids < 0
    kinds = dict(zip(positive["doc_id"].tolist(), positive[CATEGORIES].to_numpy(dtype=float)))
    worth = dict(zip(positive["doc_id"].tolist(), positive["worth"].tolist()))
    asked = [i for i in range(len(total)) if not seed[i] and held_by[i]]
    near = {i: model.index.nearest(made.rows[i], 2 * NEAREST + 1) for i in asked}
    clean = (labels[:, 1:].sum(axis=1) <= 0) & ~seed
    members: dict[int, list[int]] = {}
    for i in asked:
        ids, sims = near[i]
        alike = ids[(sims > ALIKE) & (ids != i)]
        # several clean documents that say the same, and no positive one, make a passage harmless, as do more clean than positive ones that hold it
        harmless = (total[alike][clean[alike]].sum() >= SEVERAL and not (labels[alike, 1:].sum(axis=1) > labels[alike, 0]).any()) or labels[i, 0] > labels[i, 1:].sum()
        if not harmless:
            for d in held_by[i]:
                if d in kinds:
                    members.setdefault(d, []).append(i)
    # passages of a document that say the same (one quoted in another) take one share together
    twins = {d: _twins(js, near) for d, js in members.items()}
    # what a passage takes of its document's label: at first all of it
    part = {(d, i): kinds[d] for d, js in members.items() for i in js}
    own = np.zeros((len(total), len(CATEGORIES)))

    def settle() -> None:
        own[:] = 0
        for (d, i), p in part.items():
            own[i] += p
        model.shares = np.where(seed[:, None], model.shares, own / total[:, None])

    settle()
    for n in range(ROUNDS):
        vote = {}
        for d, js in members.items():
            for i in js:
                ids, sims = near[i]
                keep = (ids != i) & ~((model.doc_ids[ids] == d) & (total[ids] <= 1))
                ids, sims = ids[keep][:NEAREST], sims[keep][:NEAREST]
                weight = sims.astype(np.float64) ** POWER
                # only what is said of the same category backs a label
                same = kinds[d] > 0
                mass, size = float(weight @ model.shares[ids][:, same].sum(axis=1)), float(weight.sum())
                if total[i] > 1:  # the same passage in other documents, without what this one says
                    mass, size = mass + float((own[i] - part[d, i])[same].sum()) / (total[i] - 1), size + 1
                vote[d, i] = mass / (size + NO_BACKING)
        for d, js in members.items():
            votes = np.array([vote[d, i] for i in js])
            if votes.max() >= BACKED:  # then the label is right, whatever it was worth alone
                told = (votes >= BACKED) / kinds[d].sum()
            else:
                most = np.zeros(twins[d].max() + 1)
                np.maximum.at(most, twins[d], votes + UNBACKED_WEIGHT)
                told = most[twins[d]] / most.sum()
                if n == ROUNDS - 1:
                    told = told * worth[d] / kinds[d].sum()
            part.update({(d, i): t * kinds[d] for i, t in zip(js, told)})
        settle()
    # an annotator may have missed something: a passage of few documents is what its neighbours clearly are
    edited = model.shares.copy()
    loud = {int(j) for i in asked if edited[i].sum() > BACKED for j in near[i][0][near[i][1] > ALIKE].tolist()}
    for j in sorted(loud):
        if not seed[j] and total[j] < SEVERAL and edited[j].sum() < 1:
            ids, sims = model.index.nearest(made.rows[j], NEAREST + 1)
            votes = model.vote(ids[ids != j][:NEAREST], sims[ids != j][:NEAREST], NO_BACKING)
            if votes.sum() > 0.7:
                edited[j] = votes / votes.sum()
    model.shares = edited


def _twins(members: list[int], near: Mapping[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A number per member that is the same for those that say the same."""
    place = {i: n for n, i in enumerate(members)}
    number = np.arange(len(members))
    for i in members:
        for j in near[i][0][near[i][1] > ALIKE].tolist():
            if j in place:
                number[number == number[place[j]]] = number[place[i]]
    return np.unique(number, return_inverse=True)[1]


def label_worth(positive: pd.DataFrame, n_docs: int, n_pairs: int, n_apart: int) -> np.ndarray:
    """How probably each of the ``positive`` documents (n_positive and n_none readings) is a case by its labels alone.

    Annotators err alike in both directions, at the rate that explains how often two of them
    disagree (``n_apart`` of ``n_pairs`` documents); without such pairs labels are taken as they are.
    """
    up, down = positive["n_positive"].to_numpy(dtype=float), positive["n_none"].to_numpy(dtype=float)
    apart = min(n_apart / n_pairs, 0.48) if n_pairs else 0.0
    error = (1 - np.sqrt(1 - 2 * apart)) / 2
    if error == 0:
        return up / np.maximum(up + down, 1)
    seen = float((up / np.maximum(up + down, 1)).sum()) / max(n_docs, 1)
    rate = min(max((seen - error) / (1 - 2 * error), 0.2 * seen), 1 - 1e-6)
    odds = rate / (1 - rate) * ((1 - error) / error) ** (up - down)
    return odds / (1 + odds)


def worst_votes(held: pd.DataFrame, made: Examples) -> np.ndarray:
    """The largest vote among each document's passages, without the examples that only it has."""
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    out = []
    for doc, texts in zip(held["doc_id"], held["passages"]):
        top = 0.0
        for p in texts:
            if p not in known:
                known[p] = made.model.index.nearest(passages.features(p), 2 * NEAREST + 1)
            ids, sims = known[p]
            alone = (made.model.doc_ids[ids] == doc) & (made.total[ids] <= 1)
            top = max(top, float(made.model.vote(ids[~alone][:NEAREST], sims[~alone][:NEAREST]).sum()))
        out.append(top)
    return np.array(out)


def calibrate(worst: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from votes to labels of held-out documents.

    The fit is drawn to a curve through 0.5 at a vote of 0.5, which stands where there are few
    labels, and kept within ``MIDDLE`` and ``LEAST_SLOPE``.
    """
    beta, prior = np.array([10.0, -5.0]), np.array([10.0, -5.0])
    x = np.stack([worst, np.ones(len(worst))], axis=1)
    pull = np.diag([0.05, 0.2])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weights * (y - p)) - pull @ (beta - prior)
        hessian = (x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + pull
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    slope = max(float(beta[0]), LEAST_SLOPE)
    middle = min(max(-float(beta[1]) / max(float(beta[0]), 1e-6), MIDDLE[0]), MIDDLE[1])
    return slope, -slope * middle


def fit(split: DataFrame, labels: DataFrame, featured: DataFrame, seeds: Mapping[str, Sequence[str]] = SEEDS) -> Model:
    idf = inverse_frequencies(featured)
    labelled = durable(labelled_documents(split, labels))
    none = F.round(F.col("none") * F.col("n_readings"))
    positive = labelled.filter("none < 1").select("doc_id", none.alias("n_none"), (F.col("n_readings") - none).alias("n_positive"), *CATEGORIES).toPandas()
    sizes = labelled.agg(
        F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("none") < 0.5, 1)).alias("p"), F.count(F.when(F.col("none") >= 0.5, 1)).alias("n"),
        F.count(F.when(F.col("n_readings") == 2, 1)).alias("pairs"), F.count(F.when((F.col("n_readings") == 2) & (F.col("none") == 0.5), 1)).alias("apart"),
    ).first()
    positive["worth"] = label_worth(positive, sizes["all"], sizes["pairs"], sizes["apart"])
    made = build(example_passages(labelled), idf, positive, seeds)
    order = [F.xxhash64(F.lit(3), "doc_id"), "doc_id"]
    picked = [labelled.filter(c).select("doc_id", "passages", "none").orderBy(*order).limit(MOST_HELD_OUT).toPandas() for c in ("none < 0.5", "none >= 0.5")]
    held = pd.concat(picked, ignore_index=True)
    if len(held):
        weights = np.concatenate([np.full(len(picked[0]), sizes["p"] / max(len(picked[0]), 1)), np.full(len(picked[1]), sizes["n"] / max(len(picked[1]), 1))])
        made.model.slope, made.model.offset = calibrate(worst_votes(held, made), 1 - held["none"].to_numpy(dtype=float), weights * len(held) / weights.sum())
    return made.model


def score_passages(featured: DataFrame, model: Model) -> DataFrame:
    """(k1, k2, score, category, passage, like_doc_id, like_passage, cosine) of passages with a positive vote."""
    # as bytes with its classes inside, since workers need not have this package
    shared = featured.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pickle.loads(shared.value)
        for pdf in batches:
            out = []
            for k1, k2, passage, (ids, sims) in zip(pdf["k1"], pdf["k2"], pdf["passage"], m.index.nearest_many(pdf["features"].tolist(), NEAREST)):
                told = m.judge(ids, sims)
                if told:
                    score, category, doc, like, cosine = told
                    out.append((k1, k2, score, category, passage, doc, like, cosine))
            frame = pd.DataFrame(out, columns=["k1", "k2", "score", "category", "passage", "like_doc_id", "like_passage", "cosine"])
            yield frame.astype({"like_doc_id": "Int64"})

    return featured.select("k1", "k2", "passage", "features").mapInPandas(work, "k1 long, k2 long, score double, category string, passage string, like_doc_id long, like_passage string, cosine double")


def score_documents(docs: DataFrame, labels: DataFrame, seeds: Mapping[str, Sequence[str]] = SEEDS) -> DataFrame:
    """(doc_id, score, category, passage, like_doc_id, like_passage, cosine) of documents with a positive vote."""
    split = durable(split_documents(docs))
    featured = durable(with_features(corpus_passages(split)))
    scored = durable(score_passages(featured, fit(split, labels, featured, seeds)))
    held = split.select("doc_id", F.explode("passages").alias("passage")).select("doc_id", *_keys("passage"))
    worst = F.max(F.struct("score", "category", "passage", "like_doc_id", "like_passage", "cosine")).alias("w")
    return held.join(scored, ["k1", "k2"]).groupBy("doc_id").agg(worst).select("doc_id", "w.*")


def all_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its score; 0 where no passage has a positive vote."""
    scored = score_documents(docs, labels)
    return docs.select("doc_id", "source").join(scored, "doc_id", "left").fillna(0.0, ["score"])


def rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents, flagged documents and their share per source (as it is written when folded)."""
    from helixmill.functions.text import fold

    source = F.regexp_replace(fold(F.coalesce(F.col("source"), F.lit("(none)"))), "[ _-]+", "_").alias("source")
    flagged = F.col("score") >= threshold
    by = [F.count(F.when(flagged & (F.col("category") == c), 1)).alias(f"n_{c}") for c in CATEGORIES]
    return scores.groupBy(source).agg(F.count(F.lit(1)).alias("n_docs"), F.count(F.when(flagged, 1)).alias("n_flagged"), F.round(F.avg(flagged.cast("double")), 6).alias("flagged_share"), *by)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
