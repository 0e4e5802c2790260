"""Sentences marked by hand: what is in double angle brackets is personal data of the kind named before it.

They don't come from the generators' patterns or the made-up training sentences.
"""

MARKED = """
Please reach me under email:<<maria.lopez (at) correo (dot) es>> before Friday.
You can write to email:<<jens_kruse [at] web [dot] de>> or simply drop by.
My address is email:<<tom at example dot org>> as always.
Contact: email:<<press{at}museum{dot}fr>>
We met at noon. The dog ran off.
She looked at home. Then she left.
He works at acme.systems and likes it.
The talk is at room dot matrix, second floor.
mail me: email:<<a.b-c @ mail.example.com>> thanks
Send it to email:<<support [@] shop [.] io>> please
Call the office on phone:<<(030) 901820>> after nine.
Tel. phone:<<0151/23456789>> or by post.
My mobile is phone:<<07700 900123>> in the evening.
Ring phone:<<020 7946 0018>> and ask for Ann.
phone phone:<<555.014.2277>> is out of order
Fax: phone:<<0049 89 1234567>>
Llame al phone:<<91 123 45 67>> por favor
appelez le phone:<<01 23 45 67 89>> demain
numero phone:<<(212) 555-0187>> is new
WhatsApp phone:<<0171-5558822>> works too
The meeting was on 2023-11-04 and lasted until 2023-11-05.
Born 12/31/1999, died 01/02/2077.
ISBN 978-3-16-148410-0 is out of print.
Order 20240117 has shipped with parcel 00340434161094.
Version 10.15.7 follows 10.14.6 in the list.
Between 1914 - 1918 and 1939 - 1945 there was war.
The figures 1 2 3 4 5 6 7 8 9 10 were read out.
It cost 1.250.000 and then 1.300.000 in the end.
Scores were 21-19, 18-21, 21-15 that day.
Pi is 3.14159265358979 or nearly so.
Coordinates 52.520008 13.404954 mark the spot.
See pages 112-118, 204-210 and 330.
The law of 1998/2003/2011 applies.
Page 3 of 12 (1234567) was missing.
At 10:30 12 people came, at 11:45 30 more.
SKU 4006381333931 is sold out.
Serial 1234-5678 does not exist.
Total 12 345 678 units were made.
Pay with card card:<<4111/1111/1111/1111>> today.
credit card number: card:<<5500.0000.0000.0004>> exp 09/27
My visa is card:<<4012_8888_8888_1881>> I think
card card:<<4222 2222 2222 2>> was declined
Invoice 4111 1111 1111 1112 is unpaid.
Reference 1234.5678.9012.3456 was given.
The host is ip:<<192[.]168[.]0[.]17>> behind a wall.
login from ip:<<10(.)20(.)30(.)40>> at night
server ip:<<172 . 16 . 5 . 9>> is down
Section 4.3.2.1 covers that.
Chapter 1. 2. 3. 4 are short.
Numbers 300[.]400[.]500[.]600 cannot be.
"""
