"""Written by fit.py; see there."""

RULES = """
CASE
WHEN near_n >= 48.9D AND switches >= 0.23957D AND marks <= 0.15752D AND n >= 68.5D THEN 'junk'
WHEN marks <= 0.02002D AND numbers >= 0.33908D AND longest >= 7.5D THEN 'junk'
WHEN switches >= 0.60109D AND n >= 39.5D THEN 'junk'
WHEN word_count >= 4.5D AND code >= 0.07916D AND numeric >= 0.21111D AND numbers <= 0.27793D AND n >= 25.0D THEN 'junk'
WHEN run >= 5.0D THEN 'junk'
WHEN clusters >= 0.08541D AND switches <= 0.01538D THEN 'junk'
WHEN upper >= 0.04073D AND n >= 106.5D AND marks >= 0.03693D THEN 'junk'
WHEN marks >= 0.47383D AND numeric >= 0.00649D AND n >= 32.5D THEN 'junk'
WHEN upper >= 0.13423D AND equals >= 0.00735D THEN 'junk'
WHEN word_count >= 15.5D AND word_length >= 6.51944D AND letters <= 0.73805D THEN 'junk'
WHEN switches >= 0.54919D AND marks <= 0.13393D THEN 'junk'
WHEN letters <= 0.36189D AND numbers >= 0.14365D AND alike >= 0.5D AND near_stop <= 0.1D AND marks >= 0.02129D AND code <= 0.48529D THEN 'table'
WHEN letters <= 0.51236D AND numbers >= 0.14295D AND word_length >= 2.78175D AND near_numeric >= 0.43579D AND n >= 28.5D THEN 'table'
WHEN letters <= 0.52327D AND near_alike >= 0.55D AND vowels <= 0.39767D AND numbers <= 0.28286D AND word_length >= 2.26786D AND equals <= 0.25391D THEN 'table'
WHEN letters <= 0.68801D AND angles >= 0.08724D THEN 'table'
WHEN letters <= 0.42608D AND marks <= 0.36182D AND first_number <= 0.5D AND n >= 11.5D THEN 'table'
WHEN near_gaps >= 0.37643D AND switches <= 0.0102D AND n >= 25.5D THEN 'table'
WHEN separators >= 0.40833D AND code <= 0.09307D AND near_alike >= 0.1D THEN 'table'
WHEN near_gaps >= 0.29881D AND letters <= 0.28175D AND code <= 0.17339D AND near_first_mark >= 0.225D THEN 'table'
WHEN gaps >= 0.29167D AND numbers <= 0.52593D THEN 'table'
WHEN word_count <= 1.5D AND code >= 0.16228D AND letters >= 0.70714D AND switches <= 0.35234D THEN 'table'
WHEN switches <= 0.00735D AND separators >= 0.125D THEN 'table'
WHEN near_alike >= 0.55D AND near_stop <= 0.1D AND near_n <= 24.45D AND n >= 14.5D AND letters <= 0.80861D AND near_separators <= 0.06458D THEN 'list'
WHEN longest <= 7.5D AND near_n <= 39.225D AND near_stop <= 0.1D AND letters >= 0.69398D AND letters <= 0.8619D AND upper <= 0.02941D THEN 'list'
WHEN longest <= 8.5D AND n <= 46.5D AND letters >= 0.56696D AND near_stop <= 0.1D AND near_code <= 0.05264D AND marks >= 0.01163D AND upper <= 0.03125D THEN 'list'
WHEN n <= 23.5D AND alike >= 0.5D AND marks <= 0.08514D AND near_code <= 0.01703D AND near_n <= 26.5D AND near_numeric <= 0.18333D THEN 'list'
WHEN n <= 26.5D AND near_first_mark >= 0.55D AND word_count >= 3.5D AND upper <= 0.02778D AND marks >= 0.04083D THEN 'list'
WHEN n <= 24.5D AND near_alike >= 0.55D AND vowels <= 0.41886D AND numbers >= 0.02083D AND switches >= 0.16228D AND word_length >= 13.5D AND letters <= 0.83804D THEN 'list'
WHEN longest <= 7.5D AND word_length >= 4.65152D AND upper <= 0.00862D AND n <= 23.5D AND stop <= 0.5D AND near_gaps <= 0.19231D AND near_separators <= 0.22949D THEN 'list'
WHEN longest <= 8.5D AND n <= 47.5D AND letters >= 0.59167D AND near_first_mark >= 0.55D AND upper <= 0.01351D AND first_mark >= 0.5D THEN 'list'
WHEN longest <= 7.5D AND word_length >= 4.84524D AND stop <= 0.5D AND marks >= 0.02145D AND n <= 51.5D AND near_numeric <= 0.36667D THEN 'list'
WHEN n <= 21.5D AND marks <= 0.12132D AND near_n <= 20.225D AND letters <= 0.81653D AND alike >= 0.5D THEN 'list'
WHEN n <= 25.5D AND marks <= 0.08514D AND near_n <= 14.325D AND switches >= 0.06458D AND vowels <= 0.43056D THEN 'list'
WHEN n <= 25.5D AND near_alike >= 0.55D AND word_length >= 16.5D AND letters <= 0.83409D THEN 'list'
WHEN n <= 24.5D AND marks <= 0.11438D AND longest <= 8.5D AND n >= 17.5D AND first_number >= 0.5D THEN 'list'
WHEN longest <= 8.5D AND word_count <= 7.5D AND letters >= 0.54196D AND longest >= 7.5D AND word_length >= 5.07143D AND stop <= 0.5D AND n >= 11.0D THEN 'list'
WHEN n <= 21.5D AND marks <= 0.12917D AND longest <= 8.5D AND marks >= 0.09762D AND stop <= 0.5D AND upper <= 0.16667D THEN 'list'
WHEN n <= 21.5D AND marks <= 0.07418D AND code >= 0.02381D AND letters <= 0.82976D THEN 'list'
ELSE NULL END
"""
