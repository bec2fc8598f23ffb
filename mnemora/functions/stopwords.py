"""Words that are never keywords."""

STOPWORDS = (
    "the and that this with from for are was were has have had not but you your his her its our their they them then than there "
    "der die das und ist nicht mit von den dem des ein eine für auf les des une est que qui dans pour par sur avec pas los las del una por con para como "
    "表示 进行 没有 可以 已经 不是 这个 那个 什么 他们 我们 因为 所以 但是 如果"
).split()
