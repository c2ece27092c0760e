"""Words that are common in any text."""

#: The most common words of the corpus's languages that are written with spaces.
COMMON = (
    "the of and to in is it that was for on are as with be this have from or by not but what all were when we there can an your which if will each how them then she many some so these would other into has more two like him see time could no make than been its now people my made over did down only way find use may long little very after words just where most know "
    "der die und das ist nicht ein eine mit den von zu auf für im dem sich les des est une pour dans que qui sur pas plus el los las una por con para como del o os um uma não na ya wa kwa ni и в не на что с по"
).split()
