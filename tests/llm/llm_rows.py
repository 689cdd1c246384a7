"""Constants that the tests of this folder share."""

SF = "/root/testdata/sf0.001"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
