import random

from itertools import combinations, permutations

from tessera.llm.names import Trie, allowed, components, fit, link_spellings, near_forms, plain, read_name, spelling_pairs


def distance(a, b):
    """Edits between two words, swapping neighbours being one."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_trie_finds_what_brute_force_finds():
    random.seed(0)
    words = ["".join(random.choice("abc") for _ in range(random.randint(0, 7))) for _ in range(200)]
    trie = Trie()
    for word in words:
        trie.add(word, word)
    for probe in words[:60]:
        for bound in (0, 1, 2):
            assert sorted(trie.near(probe, bound)) == sorted((distance(probe, w), w) for w in words if distance(probe, w) <= bound)


def test_keys_for_accents_are_taken_back():
    assert [plain(t) for t in ("quyeets", "định", "Khaaus".lower(), "brieuf", "nguyễn", "qdd")] == ["quyet", "dinh", "khau", "brieu", "nguyen", "qd"]


def same(spark, kind, *names):
    df = spark.createDataFrame([(f"m{i:03d}", n, kind) for i, n in enumerate(names)], "mention_id string, name string, type string")
    return sorted(map(tuple, spelling_pairs(link_spellings(df, "mention_id", "name", "type")).collect()))


def test_spellings_of_one_person(spark):
    names = ["Lê Gúc Băp Cui", "Gúc Băp Cui Lê", "CUI, LÊ GÚC BĂP", "Lê G. Băp Cui", "L.G. Băp Cui", "bị cáo Lê Gúc Băp Cui", "Lê Gúc-Băp-Cui", "Lê Gúc Băp Cuj", "Ba Băp Cui", "Lê Gúc Băp Cui (tức Ba Cui)"]
    assert len(same(spark, "CHU_THE", *names)) == len(names) * (len(names) - 1) // 2


def test_other_bearers_stay_apart(spark):
    assert same(spark, "CHU_THE", "Lê Gúc Băp Cui", "vợ ông Lê Gúc Băp Cui", "các thừa kế của ông Lê Gúc Băp Cui", "Trần Mìn Hoẽt Rem") == []
    assert same(spark, "CHU_THE", "Công ty cổ phần Xây dựng Rệp Chiẽng Tuãt Tệm", "Chi nhánh số 1 Công ty cổ phần Xây dựng Rệp Chiẽng Tuãt Tệm", "Chi nhánh 2 Công ty cổ phần Xây dựng Rệp Chiẽng Tuãt Tệm") == []
    assert same(spark, "CO_QUAN", "Tòa án nhân dân huyện Goét Plùu Lữp", "Viện kiểm sát nhân dân huyện Goét Plùu Lữp", "TAND tỉnh Goét Plùu Lữp", "VKSND h. Goét Plùu Lữp") == [("m001", "m003")]
    assert same(spark, "VBPL", "Luật số 1/2030/QH16", "Luật số 11/2030/QH16", "Luật 1/2030/QH16") == [("m000", "m002")]


def test_two_bearers_with_one_nickname_stay_apart(spark):
    assert same(spark, "CHU_THE", "Lê Gúc Băp Cui", "Trần Mìn Băp Cui", "Ba Băp Cui") == []


def test_odd_rows(spark):
    rows = [("a", None, "VBPL"), ("b", "", "VBPL"), ("c", "x", None), ("d", "x", "ORG"), ("e", "…", "VBPL"), ("f", "?!", "VBPL"), ("g", "Quốc hội " * 3000, "CO_QUAN"), ("h", "a", "DIEU"), ("h", "a", "DIEU"), (None, "a", "DIEU")]
    df = spark.createDataFrame(rows, "mention_id string, name string, type string")
    linked = link_spellings(df.withColumnRenamed("mention_id", "bearer"), "bearer", "name", "type")
    assert sorted(r.mention for r in linked.collect()) == ["b", "e", "f", "g", "h"] and spelling_pairs(linked).count() == 0
    assert link_spellings(df.limit(0), "mention_id", "name", "type").count() == 0


def test_components(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdefgh"], "id string")
    links = spark.createDataFrame([("h", "g"), ("g", "f"), ("f", "e"), ("a", "b")], "a string, b string")
    assert {r.id: r.label for r in components(nodes, links).collect()} == dict(zip("abcdefgh", "aacdeeee"))


def test_reading_a_decision():
    forms = [read_name(n, "VBPL") for n in ("Quyết định số 7/2030/QĐ-UBND của UBND xã Nơi Biẹm", "qđ 7/2030/qđ-ubnd xã nơi biẹm", "UBND x. Nơi Biẹm, Quyết định số 7/2030/QĐ-UBND")]
    assert len({(f[0], f[1], tuple(f[3])) for f in forms}) == 1


def within(a, b):
    """Whether two names lie within the bound: edits inside tokens, in any order of them, or one space lost, added or moved."""
    a, b = list(a), list(b)
    bound = min(allowed(a), allowed(b))
    if len(a) == len(b) and min(sum(distance(x, y) for x, y in zip(a, order)) for order in permutations(b)) <= bound:
        return True
    joined = lambda t: {tuple(sorted(t))} | {tuple(sorted([*t[:i], t[i] + t[i + 1], *t[i + 2 :]])) for i in range(len(t) - 1) if allowed(t)}
    return bool(joined(a) & joined(b))


def spelled(syllables, n):
    names = [random.sample(syllables, random.choice((1, 2, 3, 3, 4))) for _ in range(n)]
    for tokens in list(names):
        word = " ".join(tokens)
        for edits in (1, 1, 2):
            changed = word
            for _ in range(edits):
                i = random.randrange(len(changed) - 1) if len(changed) > 1 else 0
                changed = random.choice((changed[:i] + changed[i + 1 :], changed[:i] + "x" + changed[i:], changed[:i] + changed[i : i + 2][::-1] + changed[i + 2 :]))
            names.append(changed.split())
        names.append(tokens[::-1])
    return sorted({tuple(t) for t in names if all(t)})


def found_groups(spark, names, most):
    df = spark.createDataFrame([(i, "X", "", "full", list(t)) for i, t in enumerate(names)], "id int, exact string, level string, kind string, tokens array<string>")
    links = [(r.a, r.b) for r in near_forms(df, most).collect()]
    labels = components(df.select("id"), spark.createDataFrame(links or [(0, 0)], "a int, b int"))
    return set(links), {r.id: r.label for r in labels.collect()}


def test_names_within_the_bound_are_linked_and_no_others(spark):
    random.seed(1)
    names = spelled(["nguyen", "van", "an", "tran", "thi", "minh", "khoa", "phuong", "truong", "thanh", "le", "cui"], 25)
    links, labels = found_groups(spark, names, 300)
    expected = {(i, j) for (i, a), (j, b) in combinations(enumerate(names), 2) if within(list(a), list(b))}
    # Beyond the bound, only a space between tokens that are neighbours in another order may be lost.
    for i, j in {tuple(sorted(p)) for p in links} - expected:
        a, b = names[i], names[j]
        assert min(distance(" ".join(a), " ".join(order)) for order in permutations(b)) <= min(allowed(a), allowed(b)) or any(distance(" ".join(order), " ".join(b)) <= min(allowed(a), allowed(b)) for order in permutations(a))
    assert all(labels[i] == labels[j] for i, j in expected) and len(set(labels.values())) > 5


def test_split_shards_lose_nothing(spark):
    random.seed(2)
    syllables = ["".join(random.choice("bcdghklmn") + random.choice("aeiou") for _ in range(3)) for _ in range(12)]
    names = [n for n in spelled(syllables, 40) if len(n) > 1]
    names = sorted({("nguyen", *n[:3]) for n in names})
    whole, cut = found_groups(spark, names, 10_000), found_groups(spark, names, 4)
    found, found_cut = ({tuple(sorted(p)) for p in links} for links in (whole[0], cut[0]))
    assert found_cut <= found and {(i, j) for i, j in found if within(names[i], names[j])} <= found_cut and len(found) > 50


def test_long_names_are_linked_in_their_order(spark):
    long = "hoi dong bao ve quyen loi nguoi lam chung tai cac phien toa luu dong".split()
    names = [tuple(long), tuple([*long[:3], "vex", *long[4:]]), tuple(["hoix", *long[1:-1], "donx"]), tuple(["abc", *long[1:]])]
    _, labels = found_groups(spark, names, 300)
    assert labels[0] == labels[1] == labels[2] != labels[3]


def test_abbreviations_fit():
    assert fit(["n", "v", "an"], ["nguyen", "van", "an"]) == 0 and fit(["an", "n", "v"], ["nguyen", "van", "an"]) == 0
    assert fit(["n", "v", "anh"], ["nguyen", "van", "an"]) == 2 and fit(["v", "n", "an"], ["nguyen", "van", "an"]) == 1
    assert fit(["t", "v", "an"], ["nguyen", "van", "an"]) is None and fit(["n", "an"], ["nguyen", "van", "an"]) is None


def test_short_joined_and_reordered_spellings_meet(spark):
    assert len(same(spark, "CHU_THE", "Nguyễn Văn An", "N. V. An", "Nguyễn Vănan")) == 3
    assert len(same(spark, "CHU_THE", "Nguyễn Thanh Trường", "Nguyễnn Thanhh Trường")) == 1
    assert len(same(spark, "CHU_THE", "Trần Quang Khải", "Trần Khải Quang")) == 1


def test_the_best_fit_decides(spark):
    found = same(spark, "CHU_THE", "Nguyễn Văn An", "Nguyễn Văn Anh", "N. V. Anh")
    assert ("m001", "m002") in found or len(found) == 3  # one edit apart, the two full names are spellings of each other
    assert same(spark, "CHU_THE", "Nguyễn Bình Trung An", "Nguyễn Thanh Bảo An", "N. B. T. An") == [("m000", "m002")]


def test_many_full_names_with_one_abbreviation(spark):
    names = [(i, "CHU_THE|", "", "full", ["nguyen", "van", f"a{c}{d}"]) for i, (c, d) in enumerate((c, d) for c in "bcdghk" for d in "bcdghk")]
    names += [(100, "CHU_THE|", "", "initial", ["n", "v", "abc"]), (101, "CHU_THE|", "", "nick", ["van", "akk"])]
    df = spark.createDataFrame(names, "id int, exact string, level string, kind string, tokens array<string>")
    weak = [{(r.a, r.b, r.cost) for r in near_forms(df, most).where("weak").collect()} for most in (4, 1000)]
    assert weak[0] == weak[1] and {(100, 1, 0), (101, 35, 0)} <= weak[0]
