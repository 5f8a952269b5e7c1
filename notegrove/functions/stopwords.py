"""Words that carry no topic, by language. Data only: one string a language, in order of length."""

from __future__ import annotations

_BY_LANGUAGE = {
    "en": """
a i be he me we if of an in on do to or as is at it by my had did and she the are can ago who for our has was get but you how now may why find were
have give with tell will them from been then when into help over your does this that what just show they could would while where these those above
stuff being thing which under later after might about below today should before please during things because nothing through between earlier anything
tomorrow recently something yesterday everything
""",
    "es": """
a o y la de me mi si el en un yo es tu una esa ese fue que del con son ser por las los tus hoy qué para esta este como cómo pero ayer unas unos ayuda
ahora usted donde dónde sobre entre estar haber hacer tener favor ellas antes ellos mañana porque fueron cuando cuándo porquê ustedes despues después
nosotras nosotros recientemente
""",
    "pt": """
a e o é da de me se em um do as os eu ou ela uma ele que foi com são ser ter por mas uns nos nós meu quê para essa esta onde hoje esse este como elas
umas eles você ajuda minha agora sobre entre foram ontem estar fazer favor antes vocês porque quando depois amanhã porquê recentemente
""",
    "ar": """
ب ك ل و مع ال بل هل ثم هم عن من أو هو في هي غدا هذا أنا هنا بعد صار امس كيف تلك ذلك قبل كان نحن لكن أين بين هذه متى إلى الى على ماذا فضلا كانت أصبح
ساعد هناك الآن ممكن يمكن تكون يكون لماذا مؤخرا اليوم بالأمس
""",
    "ko": """
가 거 것 곳 과 그 께 나 너 는 더 도 등 때 또 로 를 만 뭐 분 수 에 와 왜 은 을 의 이 잘 저 좀 중 내가 그것 이것 저것 에게 누구 최근 지금 거기 여기 저기 아까 그녀 나는 또는 오늘 가다 되다 마다 보다 없다 오다 이다 있다 주다 하다 그들 어디 어떤
처럼 대로 으로 나를 우리 정말 너무 제발 에서 무엇 밖에 전에 매우 같이 많이 내일 어제 언제 아주 나중 까지 부탁 부터 한테 저희 어떻게 그리고 그러나 아니다 그런데 하지만 그러면 그래서
""",
    "ja": """
の 今 何 前 後 誰 どう だけ ここ そこ どこ です ます なぜ した また いつ して まで こと あの この その もの ため でも から より ある いる する なる あれ これ それ どれ 今日 明日 昨日 最近 さっき あそこ しかし そして できる
""",
    "zh": """
与 也 了 事 他 会 但 你 做 再 到 去 又 只 吗 吧 呀 呢 和 啊 啦 嘛 在 地 她 它 就 帮 得 想 我 或 才 找 把 是 有 来 用 的 看 着 给 而 能 被 要 让 说 请 过 还 这 那 都 哪个 这个 那个 因为 什么 怎么 哪些 这些 那些 可以 所以 他们 你们
我们 之前 以前 之后 以后 现在 今天 明天 昨天 多少 帮忙 事情 刚才 但是 如果 虽然 东西 告诉 最近 为什么
""",
}

#: Language -> its stop words.
BY_LANGUAGE = {name: tuple(text.split()) for name, text in _BY_LANGUAGE.items()}
#: All of them in order.
STOP_WORDS = tuple(sorted(set().union(*BY_LANGUAGE.values())))

#: English words that the re-rankers leave out.
RERANK_STOP_WORDS = tuple(
    """
a i be he me we of an in on do no so to up or is at it by my had did and see she the one are use all can who two her for our has was his its get got
not but out you saw new how now may say why any need used said told made make take like came come some were more gave have give much with look took
tell will them from been then when also into your does this says that what want went just know they very could would three where these those being
which think shall still other their might about should
""".split()
)
