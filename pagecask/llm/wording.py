"""Function words and words of address of the eight languages, shared by the rules on blocks and messages."""

from __future__ import annotations

# Frequent function words of the eight languages.
STOP_WORDS = frozenset(
    """the a an of and to in is was on at for with by from that this it as but or not were are be been had has have until so because while
    der die das den dem des ein eine einer und oder in im am an auf aus bei mit nach von zu zum zur ist war sind nicht wird für bis hinter ohne neben seit
    le la les un une des du de et ou à au aux en dans sur sous par pour avec sans est était ne pas que qui mais car près
    el los las una unos y o del al con por para sin es era no que pero porque hasta desde entre su
    o os as um uma e do da dos das no na nos nas ao à em com por para sem é era não mas porque até
    de het een en of van in op te aan bij met naar voor uit om is was niet maar want door onder tot zonder
    ο η το οι τα τη να του της των τον την στο στη στην στον και ή σε από με για χωρίς είναι ήταν δεν αλλά μέχρι κατά μετά πριν πίσω δίπλα κοντά
    и в во на с со у к по за из от до для без не но что как под над при о об между же бы был была было""".split()
)

# Words with which a site speaks to its reader, in the eight languages.
ADDRESS = frozenset(
    """we us our ours you your yours i my
    wir uns unser unsere unseren unserem sie ihr ihre ihrem ihren mein meine
    nous notre nos vous votre vos mon mes
    nosotros nuestro nuestra usted ustedes su sus mi
    nós nosso nossa você sua seu suas seus minha
    wij ons onze u uw mijn
    μας σας εμείς εσείς μου
    мы нас наш наша нашу вы вас вам ваш ваша вашу вашей мой""".split()
)
